"""Main text of web pages by wrapper induction.

Pages of one host and layout are aligned with a reference page by simple tree matching. Nodes whose text is the same on nearly all pages are
template. So are the short slots that every page has once beside the region of the varying text, and slots that hold links alone. What
varies is content.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import slices
from recordloom.session import cut_lineage

#: A text is template if so many pages, and so large a share of those that have its slot, agree on it.
LEAST_PAGES, CONSTANT = 3, 0.9
#: The region holds this share of the varying text of a layout; a slot beside it is short below that share of the region's text.
REGION, SHORT = 0.8, 0.1
#: Links make up at least this share of the text of a slot of links.
LINKS = 0.8
#: Host tables up to so many bytes, measured once they are written, go to every task; larger ones are joined by host and layout.
BROADCAST_BYTES = 16 << 20
#: Trees a worker remembers by host and layout.
REMEMBERED = 256
#: Elements below this depth become siblings there, as in browsers.
DEEPEST = 512
#: Cells of an alignment table; larger ones are halved until they fit.
CELLS = 1 << 20

_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""=\s*["']|>""")
_SPACE = re.compile(r"[ \t\n\r\f\v   \u0085]{2,}|[\t\n\r\f\v   \u0085]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Never content.
DROPPED = frozenset("head nav footer aside form button input fieldset dialog menu map audio video canvas applet frame frameset".split())
#: Elements whose whole text is skipped, and of these the ones that run to the end of the page if they are not closed.
SKIPPED = {
    t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A)
    for t in "script style noscript template svg math iframe object textarea select title".split()
}
RAW = frozenset("script style noscript iframe textarea title".split())
#: Elements that hold others and may be slots of a page; all other blocks hold text.
CONTAINERS = frozenset("article aside center details div dl fieldset figure footer form header html body main menu nav ol section table tbody ul".split())
#: Words that mark a class, id or role as no article, if all its words are marked or neutral.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments respond reply replies disqus pagination pager "
    "toolbar widget search skip complementary contentinfo".split()
)
NEUTRAL = frozenset(
    "area bar block bottom box button buttons center column container div element form group holder icons inner item items left link links "
    "list main module outer page panel placeholder post posts primary right row secondary section site slot thread top unit wrap wrapper".split()
)
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: Block elements end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split()
)


class Node:
    """An element: its tag, its label (tag and names, digits as #), whether it is marked as no content, and what it holds in order."""

    __slots__ = ("tag", "label", "off", "parts", "text", "template", "path", "depth", "above", "below", "hidden", "linked", "leaf")

    def __init__(self, tag: str, label: str, off: bool) -> None:
        self.tag, self.label, self.off = tag, label, off
        self.parts: list[Node | str] = []
        self.text = ""
        self.template = False
        self.path = self.depth = 0
        self.above: Node | None = None
        self.below: list[Node] | None = None
        self.hidden = self.linked = self.leaf = False

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str)]

    def blocks(self) -> list[Node]:
        """The next elements below that are not inline, in page order."""
        if self.below is None:
            out, stack = [], self.nodes()[::-1]
            while stack:
                node = stack.pop()
                if node.tag in INLINE:
                    if node.parts:
                        stack.extend(reversed(node.nodes()))
                else:
                    out.append(node)
            self.below = out
        return self.below


def marks(names: str) -> bool:
    """Whether one of the names says that an element is no article: all its words are marked or neutral, one at least marked."""
    for name in names.split():
        parts = {x.lower() for x in _PART.findall(name) if not x.isdigit()}
        if not MARKED.isdisjoint(parts) and parts <= MARKED | NEUTRAL:
            return True
    return False


def _element(tag: str, attributes: str) -> Node:
    names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if "=" in attributes else ""
    if not names:
        return Node(tag, tag, tag in DROPPED)
    return Node(tag, f"{tag} {_DIGITS.sub('#', names)}", tag in DROPPED or tag not in ("html", "body") and marks(names))


class _Scanner:
    """Where the tags of a page end. Every scan that finds nothing is remembered, so that all of them together read the page a few times."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.loose = False
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def closing(self, tag: str, at: int) -> int:
        """Where the end tag of a skipped element begins, or -1."""
        if tag in self.missing:
            return -1
        m = SKIPPED[tag].search(self.page, at)
        if m is None:
            self.missing.add(tag)
            return -1
        return m.start()

    def tag_end(self, at: int) -> int:
        """The `>` of a tag: the first outside quoted values, or, once quotes have run to the end of the page, the first of all."""
        if self.page.startswith(">", at):
            return at
        place = at
        while not self.loose:
            m = _STOP.search(self.page, place)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            close = self.find(m[0][-1], m.end())
            if close < 0:
                break
            place = close + 1
        self.loose = True
        return self.find(">", at)


def parse(page: str) -> Node:
    """The elements of a page, in one pass. Comments, scripts, styles and their like are left out; elements that are not closed end with their
    parent; a tag that is not ended ends the page. The work is in proportion to the page whatever its markup."""
    root = Node("", "", False)
    stack = [root]
    opened: Counter[str] = Counter()
    scan = _Scanner(page)
    at, size = 0, len(page)

    def shut(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    begin = 0
    while begin < size:
        begin = scan.find("<", begin)
        if begin < 0:
            break
        after = page[begin + 1 : begin + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", begin):
                end = scan.find("-->", begin + 4)
                stop = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", begin):
                end = scan.find("]]>", begin + 9)
                stop = size if end < 0 else end + 3
            else:
                end = scan.find(">", begin)
                stop = size if end < 0 else end + 1
            stack[-1].parts.append(page[at:begin])
            if page.startswith("<![CDATA[", begin):
                stack[-1].parts.append(entities.escape(page[begin + 9 : size if end < 0 else end]))
            at = begin = stop
            continue
        closes = after == "/"
        m = _TAG.match(page, begin + 1 + closes)
        if m is None:
            begin += 1
            continue
        stack[-1].parts.append(page[at:begin])
        end = scan.find(">", m.end()) if closes else scan.tag_end(m.end())
        if end < 0:
            at = size
            break
        at = begin = end + 1
        tag, attributes = m[0].lower(), page[m.end() : end]
        if closes:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                shut(depth)
            continue
        if tag in SKIPPED and not (attributes.endswith("/") and tag not in RAW):
            end = scan.closing(tag, at)
            if end >= 0:
                end = scan.find(">", end)
                at = begin = size if end < 0 else end + 1
            elif tag in RAW:
                at = size
                break
            continue
        if tag in ENDS_P or tag in CLOSES:
            ends = CLOSES.get(tag, CLOSES["p"])
            # Only inline elements may stand between.
            if any(opened[t] for t in ends):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in ends:
                        shut(depth)
                        break
                    if stack[depth].tag not in INLINE and stack[depth].tag != "p":
                        break
        node = _element(tag, attributes)
        stack[-1].parts.append(node)
        if tag not in VOID and not attributes.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
            opened[tag] += 1
    if at < size:
        stack[-1].parts.append(page[at:])
    return root


def clean(text: str) -> str:
    """Character references decoded, white space made single spaces, trimmed."""
    return _SPACE.sub(" ", entities.unescape(text) if "&" in text else text).strip()


def numbered(root: Node) -> list[Node]:
    """All blocks in page order; each gets the text it holds directly (with its inline elements'), its path of labels and its depth.

    A header is content only inside an article, a main or a section. A block is hidden if it or one above is marked as no content, linked if
    its text has links, a leaf if its whole content is its text.
    """
    out, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        out.append(node)
        if node.tag == "header" and not inside:
            node.off = True
        node.hidden = node.off or node.above is not None and node.above.hidden
        node.leaf = not node.blocks()
        direct = []
        held = [iter(node.parts)]
        while held:
            for part in held[-1]:
                if isinstance(part, str):
                    direct.append(part)
                elif part.tag in INLINE:
                    if part.tag == "br":
                        direct.append(" ")
                    elif part.off:
                        node.leaf = False
                    elif part.tag == "a":
                        node.linked = True
                    if part.parts:
                        held.append(iter(part.parts))
                        break
            else:
                held.pop()
        node.text = clean("".join(direct)) if direct else ""
        inside = inside or node.tag in ("article", "main", "section")
        for child in reversed(node.blocks()):
            child.above, child.depth = node, node.depth + 1
            child.path = _hash(f"{node.path} {child.label}")
            stack.append((child, inside))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def common(u: np.ndarray, v: np.ndarray, cells: int = CELLS) -> list[tuple[int, int]]:
    """Pairs of places of a longest common sequence. Tables beyond `cells` are halved first, so memory stays bounded."""
    out, stack = [], [(0, len(u), 0, len(v))]
    while stack:
        a, b, c, d = stack.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= cells or b - a == 1:
            best = np.zeros((b - a + 1, d - c + 1), np.int32)
            for i in range(b - a):
                best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (v[c:d] == u[a + i])))
            i, j = b - a, d - c
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
            continue
        half = (a + b) // 2
        cut = c + int(np.argmax(_lengths(u[a:half], v[c:d]) + _lengths(u[half:b][::-1], v[c:d][::-1])[::-1]))
        stack += [(a, half, c, cut), (half, b, cut, d)]
    return out


def _lengths(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Lengths of the longest common sequences of u with every beginning of v."""
    row = np.zeros(len(v) + 1, np.int32)
    for x in u:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (v == x)))
    return row


def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes by simple tree matching: roots of equal labels, their children in order, as many as possible, and so down.

    Equal labels at either end of the children are paired first; the longest common sequence is only needed between.
    """
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        left, right = x.blocks(), y.blocks()
        begin = 0
        while begin < min(len(left), len(right)) and left[begin].label == right[begin].label:
            stack.append((left[begin], right[begin]))
            begin += 1
        left, right = left[begin:], right[begin:]
        while left and right and left[-1].label == right[-1].label:
            stack.append((left.pop(), right.pop()))
        if left and right:
            names = {n.label: i for i, n in enumerate([*left, *right])}
            u, v = (np.array([names[n.label] for n in side]) for side in (left, right))
            stack.extend((left[i], right[j]) for i, j in common(u, v))
    return pairs


def _weight(node: Node) -> int:
    """Characters of text below a node that may be content."""
    total, stack = 0, [node]
    while stack:
        n = stack.pop()
        if not n.off:
            total += len(n.text)
            stack.extend(n.blocks())
    return total


def _main(root: Node) -> list[Node]:
    """Where content is looked for: the outermost articles or, without any, mains; else the whole page."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.off:
                continue
            if (node.tag == tag or tag == "main" and "main" in node.label.split()[1:]) and _weight(node):
                found.append(node)
            else:
                stack.extend(reversed(node.blocks()))
        if found:
            return found
    return [root]


def _link_chars(node: Node) -> int:
    """Characters of the links among a node's direct text."""
    total, stack = 0, [(p, False) for p in node.parts]
    while stack:
        part, inside = stack.pop()
        if isinstance(part, str):
            total += len(clean(part)) if inside else 0
        elif part.tag in INLINE:
            stack.extend((p, inside or part.tag == "a") for p in part.parts)
    return total


def main_text(root: Node, slots: frozenset[int] = frozenset()) -> str:
    """The content blocks in page order, joined by two line breaks.

    `slots` are paths of template slots, which count outside articles. Nodes found constant lose their own text unless that would be more
    than half of the page's: then the page is a copy of others, not made of template.
    """
    blocks: list[tuple[str, bool]] = []
    run: list[str] = []
    sign = False

    def flush() -> None:
        text = clean("".join(run))
        run.clear()
        if text:
            blocks.append((text, sign))

    for top in _main(root):
        # A part goes with the sign of the block that holds it; None ends a block.
        stack: list[tuple[Node | str | None, bool]] = [(top, False)]
        while stack:
            part, fixed = stack.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                run.append(part)
                sign = fixed
            elif part.tag in INLINE:
                if part.tag == "br":
                    run.append(" ")
                elif not part.off:
                    stack.extend((p, fixed) for p in reversed(part.parts))
            elif part is top or not part.off and (part.path not in slots or top is not root):
                flush()
                if part.leaf:
                    if part.text:
                        blocks.append((part.text, part.template))
                    continue
                stack.append((None, False))
                stack.extend((p, part.template) for p in reversed(part.parts))
        flush()
    total = sum(len(t) for t, _ in blocks)
    copy = 2 * sum(len(t) for t, fixed in blocks if fixed) > total
    return "\n\n".join(t for t, fixed in blocks if copy or not fixed)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def layout_of(html: Column) -> Column:
    """A hash of which sections, and which names of div elements (without digits), a page has. Pages of a layout share a reference."""
    parts = r"(<(?:(?:nav|article|main|section|aside|header|footer|form)\b|div\s+(?:class|id)\s*=\s*[\x22']?[a-z_\-]+))"
    return F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(html), F.lit(parts), F.lit(1)))))


class _Trees:
    """Numbered trees of reference pages, by host and layout."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int], tuple[Node, dict[int, int]]] = {}

    def get(self, host: str, layout: int, page: str) -> tuple[Node, dict[int, int]]:
        key = (host, layout)
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            root = parse(page)
            self.known[key] = (root, {id(n): i for i, n in enumerate(numbered(root))})
        return self.known[key]


def _small(df: DataFrame, size: Column) -> DataFrame:
    """A written table, with a hint to broadcast it if its measured size allows; else the join goes by key."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


#: Kinds of votes: a node of the reference, a text beside it, a slot, a slot whose name marks it.
PLACE, BESIDE, SLOT, MARK = 0, 1, 2, 3
VOTES = "host string, layout long, kind int, slot long, parent long, depth int, pages long, times long, chars long, links long"
_ARROW = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def page_votes(own: Node, nodes: list[Node], root: Node, places: dict[int, int], first: bool) -> Iterator[tuple[tuple, tuple]]:
    """What one page says of its wrapper: `(kind, slot, parent, depth)` and the sums `(pages, times, chars, links)`.

    A node with text that matches the reference votes for its place: `times` says whether the texts agree. One that matches none votes for
    its path, and for path and text. A container votes for its path with the text and the links below it, marked parts left out; so does the
    top of a marked part with its own.
    """
    if not first:
        pairs = matched(root, own)
        for a, b in pairs:
            if a.text and not b.hidden:
                yield (PLACE, places[id(a)], 0, 0), (1, int(a.text == b.text), 0, 0)
        met = {id(b) for _, b in pairs}
        seen = set()
        for node in nodes:
            if node.text and not node.hidden and id(node) not in met:
                seen.update([(BESIDE, node.path, 0, 0), (BESIDE, _hash(f"{node.path} {node.text}"), node.path, 1)])
        for key in seen:
            yield key, (1, 0, 0, 0)
    below: dict[int, list[int]] = {}
    slots: dict[tuple, list[int]] = {}
    for node in reversed(nodes):
        chars, links = below.pop(id(node), (0, 0))
        chars += len(node.text)
        links += _link_chars(node) if node.linked else 0
        if node.above is not None and not (node.off and not node.above.hidden):
            held = below.setdefault(id(node.above), [0, 0])
            held[0] += chars
            held[1] += links
        if node.above is None or node.off and not node.above.hidden or node.tag in CONTAINERS and not node.hidden:
            sums = slots.setdefault((MARK if node.off else SLOT, node.path, node.above.path if node.above else 0, node.depth), [1, 0, 0, 0])
            for i, x in enumerate((1, chars, links)):
                sums[i + 1] += x
    for key, sums in slots.items():
        yield key, tuple(sums)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = _Trees()
    votes: dict[tuple, list[int]] = {}
    for batch in batches:
        for part in slices(batch, "html"):
            for host, layout, page, reference in zip(*(part.column(c).to_pylist() for c in ("host", "layout", "html", "reference")), strict=True):
                root, places = trees.get(host, layout, reference)
                own = parse(page)
                for key, sums in page_votes(own, numbered(own), root, places, page == reference):
                    total = votes.setdefault((host, layout, *key), [0, 0, 0, 0])
                    for i, x in enumerate(sums):
                        total[i] += x
            if len(votes) > 200_000:
                yield _vote_rows(votes)
                votes.clear()
    if votes:
        yield _vote_rows(votes)


def _vote_rows(votes: dict[tuple, list[int]]) -> pa.RecordBatch:
    columns = [*zip(*votes, strict=True), *zip(*votes.values(), strict=True)]
    names = [c.split()[0] for c in VOTES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], names)


def induce(pages: DataFrame) -> DataFrame:
    """`(host, layout, reference, places, texts, slots)`: of each host and layout a reference page and what is template.

    `places` are nodes of the reference whose text is constant, `texts` hashes of path and text of constant texts beside it, `slots` the paths
    of template slots. The reference is the page of least hash. Every page votes; each task sums its votes by host, layout and
    slot before they are shuffled, so a host of any size is spread over all tasks. A layout of fewer than `LEAST_PAGES` pages has no
    template: there only marked parts are left out.
    """
    by = ["host", "layout"]
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(host_of(F.col("url")).alias("host"), layout_of(html).alias("layout"), F.xxhash64(html).alias("_h"), html.alias("html"))
    least = cut_lineage(keyed.groupBy(by).agg(F.min("_h").alias("_h")))
    references = cut_lineage(keyed.join(_small(least, F.length("host") + 64), [*by, "_h"]).groupBy(by).agg(F.min("html").alias("reference")))
    given = keyed.select(*by, "html").join(_small(references, F.length("reference") * 2 + 64), by)
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "chars", "links")]
    votes = cut_lineage(given.mapInArrow(_votes, VOTES).groupBy(*by, "kind", "slot", "parent", "depth").agg(*sums))

    places = votes.filter((F.col("kind") == PLACE) & (F.col("pages") + 1 >= LEAST_PAGES) & (F.col("times") + 1 >= CONSTANT * (F.col("pages") + 1)))
    beside = votes.filter((F.col("kind") == BESIDE) & (F.col("pages") >= LEAST_PAGES))
    had = beside.filter("depth = 0").select(*by, F.col("slot").alias("parent"), F.col("pages").alias("of"))
    texts = beside.filter("depth = 1").join(had, [*by, "parent"]).filter(F.col("pages") >= CONSTANT * F.col("of"))
    found = [
        places.groupBy(by).agg(F.collect_list("slot").alias("places")),
        texts.groupBy(by).agg(F.collect_list("slot").alias("texts")),
        template_slots(votes.filter(F.col("kind").isin(SLOT, MARK))).groupBy(by).agg(F.collect_list("slot").alias("slots")),
    ]
    for part in found:
        references = references.join(part, by, "left")
    return cut_lineage(references)


def template_slots(slots: DataFrame) -> DataFrame:
    """`(host, layout, slot)`: slots beside the region of the varying text.

    The region is the deepest container that pages have once and that holds `REGION` of the layout's text outside links. Of the
    containers beside it and its holders, one is template if nearly all pages have it, once, and its text is short against the region's; or if
    links make up most of its text. A marked slot is never of the region. Inside the region only slots of links right below the body count, where the body itself is the region.
    """
    by = ["host", "layout"]
    prose = F.col("chars") - F.col("links")
    whole = slots.filter((F.col("depth") == 0) & (F.col("kind") == SLOT)).select(*by, F.col("pages").alias("n"), prose.alias("all_prose"))
    known = slots.join(whole, by).withColumn("prose", prose)
    once = F.col("times") == F.col("pages")
    # The root is always one of the chain, the others lie below each other; a path has DEEPEST steps at most.
    chain = (
        known.filter(F.col("kind") == SLOT)
        .filter((F.col("depth") == 0) | once & (F.col("prose") > 0) & (F.col("prose") >= REGION * F.col("all_prose")))
        .groupBy(by)
        .agg(
            F.collect_list("slot").alias("chain"), F.max("depth").alias("deep"),
            F.max_by("slot", "depth").alias("region"), F.max_by(F.col("prose") / F.col("pages"), "depth").alias("usual"),
        )
    )
    beside = known.join(chain, by).filter(
        (F.col("depth") > 0) & (F.col("pages") >= LEAST_PAGES)
        & F.array_contains("chain", F.col("parent")) & ~F.array_contains("chain", F.col("slot"))
    )
    short = once & (F.col("pages") >= CONSTANT * F.col("n")) & (F.col("prose") / F.col("pages") <= SHORT * F.col("usual"))
    linked = (F.col("links") > 0) & (F.col("links") >= LINKS * F.col("chars"))
    outside = F.col("parent") != F.col("region")
    return beside.filter(outside & (short | linked) | ~outside & (F.col("deep") <= 2) & linked).select(*by, "slot")


def extract_main_text(pages: DataFrame, keep: list[str] | None = None, wrappers: DataFrame | None = None) -> DataFrame:
    """Columns `keep` of `pages` (page_id and url at first) with `text` and `n_chars` (code points), one row per row.

    `wrappers` is what `induce` returned, of these pages if not given. In each page the nodes aligned with constant nodes of the
    reference, constant texts beside it and template slots are left out; the varying rest is content, of the articles or mains where a page
    has some, without menus, footers, forms, adverts and the like. Null or empty html has the empty text. A page whose URL has no
    host belongs to the host ''; hosts and layouts without a wrapper have no template. Repeated rows stay. Other columns may have any name;
    `keep` may not name `text` or `n_chars`, nor one column twice.
    """
    keep = ["page_id", "url"] if keep is None else keep
    if len({c.lower() for c in (*keep, "text", "n_chars")}) < len(keep) + 2:
        raise ValueError(f"columns {keep} clash with text and n_chars or each other")
    by = ["host", "layout"]
    html = F.coalesce("html", F.lit(""))
    wrappers = induce(pages) if wrappers is None else wrappers
    given = pages.select(
        F.struct(F.lit(0).alias(""), *[F.col(f"`{c}`") for c in keep]).alias("kept"),
        host_of(F.col("url")).alias("host"), layout_of(html).alias("layout"), html.alias("html"),
    )
    lists = ("places", "texts", "slots")
    size = F.length("reference") * 2 + 64 + sum((F.coalesce(F.size(c), F.lit(0)) * 8 for c in lists), F.lit(0))
    joined = given.join(_small(wrappers, size), by, "left").select("kept", *by, "html", "reference", *lists)
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            for part in slices(batch, "html"):
                found = []
                for host, layout, page, reference, places, texts, slots in zip(*(part.column(c).to_pylist() for c in (*by, "html", "reference", *lists)), strict=True):
                    own = parse(page)
                    nodes = numbered(own)
                    if places or texts:
                        mark_template(own, nodes, *trees.get(host, layout, reference), frozenset(places or ()), frozenset(texts or ()))
                    found.append(main_text(own, frozenset(slots or ())))
                yield pa.RecordBatch.from_arrays(
                    [*part.column("kept").flatten()[1:], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    [*keep, "text", "n_chars"],
                )

    return joined.mapInArrow(run, schema)


def mark_template(own: Node, nodes: list[Node], root: Node, places: dict[int, int], constant: frozenset[int], texts: frozenset[int]) -> None:
    """Mark the nodes of a page whose text is constant, by their place in the reference or, without one, by path and text."""
    met = set()
    for a, b in matched(root, own):
        met.add(id(b))
        b.template = bool(b.text) and places[id(a)] in constant and a.text == b.text
    for node in nodes:
        if texts and node.text and id(node) not in met:
            node.template = _hash(f"{node.path} {node.text}") in texts
