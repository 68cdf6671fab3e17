"""Wrapper induction: hostile markup, alignment against brute force, what is template on which hosts, and what stays."""

from __future__ import annotations

import time
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import wrapper


def text_of(page: str) -> str:
    root = wrapper.parse(page)
    wrapper.numbered(root)
    return wrapper.main_text(root)


def extracted(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrapper.extract_main_text(pages, **more).collect()}


@pytest.mark.parametrize(
    "piece",
    ["<a ", "<p", '<a "', "<a b='>", '<a href="', "<div>", "<script ", "<!--", "<svg>", "</x>", "<", "<p><b>", "<![CDATA[", "<table><tr><td>"],
)
def test_any_markup_is_read_in_proportion_to_its_length(piece):
    start = time.time()
    text_of(piece * 60_000 + "<p>end</p>")
    assert time.time() - start < 10


def test_unended_tags_and_quotes():
    assert text_of("<p>one</p><a href=x") == "one"
    assert text_of("<p title=it's>one</p><p>two's</p>") == "one\n\ntwo's"
    assert text_of("<p title=\"a>b\">one</p>") == "one"
    assert text_of("<p title=\"open>one</p><p>two</p>") == "one\n\ntwo"
    assert text_of("a < b <3 <p>c") == "a < b <3\n\nc"
    assert text_of("<svg><p>kept</p>") == "kept" and text_of("<script>x</p><p>lost</p>") == ""
    assert text_of("<SCRIPT>x</p></Script ><p>kept</p>") == "kept"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>"
    assert text_of(deep) == "deep\n\nafter"


def test_an_article_loses_nothing_but_marked_parts():
    assert text_of("<body><section><p>One.</p></section><section><p>Two, longer.</p></section></body>") == "One.\n\nTwo, longer."
    assert text_of("<article><p>See</p><ul><li><a href=a>First</a></li><li><a href=b>Second</a></li></ul></article>") == "See\n\nFirst\n\nSecond"
    kept = '<div class="side-effects">Effects</div><p class="search-engine">Engines</p><p class="adverbial">Adverbs</p>'
    assert text_of(f"<article>{kept}</article>") == "Effects\n\nEngines\n\nAdverbs"
    assert text_of('<article><p>Text</p><div class="ad-slot-3">Buy</div><ul class="shareButtons"><li>Mail</ul><ol id="comment-list"><li>Hi</ol></article>') == "Text"
    assert text_of("<b><p>In bold</p><p>blocks</p></b>") == "In bold\n\nblocks"


@lru_cache(None)
def longest(u: tuple, v: tuple) -> int:
    if not u or not v:
        return 0
    return max(longest(u[1:], v), longest(u, v[1:]), longest(u[1:], v[1:]) + 1 if u[0] == v[0] else 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9), st.sampled_from([1, 4, 1 << 20]))
def test_alignment_is_a_longest_common_sequence_in_any_memory(u, v, cells):
    pairs = sorted(wrapper.common(np.array(u, int), np.array(v, int), cells))
    assert len(pairs) == longest(tuple(u), tuple(v))
    assert all(u[i] == v[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def tree(spec) -> str:
    return "".join(f"<{tag}>{tree(below)}</{tag}>" for tag, below in spec)


def best(a: wrapper.Node, b: wrapper.Node) -> int:
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    u, v = a.blocks(), b.blocks()

    @lru_cache(None)
    def rows(i: int, j: int) -> int:
        if not i or not j:
            return 0
        same = int(u[i - 1].label == v[j - 1].label)
        return max(rows(i - 1, j), rows(i, j - 1), rows(i - 1, j - 1) + same)

    return rows(len(u), len(v))


SPEC = st.recursive(st.just([]), lambda s: st.lists(st.tuples(st.sampled_from(["div", "section", "dl"]), s), max_size=4), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(SPEC, SPEC)
def test_matching_pairs_as_many_children_as_the_definition(left, right):
    a, b = wrapper.parse(tree(left)), wrapper.parse(tree(right))
    pairs = wrapper.matched(a, b)
    of = {id(x): y for x, y in pairs}
    for x, y in pairs:
        met = [of[id(c)] for c in x.blocks() if id(c) in of]
        assert len(met) == best(x, y)
        places = {id(c): i for i, c in enumerate(y.blocks())}
        assert [places[id(c)] for c in met] == sorted(places[id(c)] for c in met)


#: No tag and no name says here what is content.
PLAIN = (
    '<body><div class="a1"><a href="/{i}">Start {i}</a> <a href="/x">Other {i}</a></div><div class="b"><div>Word of day {i}</div></div>'
    '<div class="c"><h1>Title {i}</h1><p>{long}</p><p>Same line on every page.</p><p>{more}</p></div><div class="d">Text {i} and more</div></body>'
)


def plain(i: int) -> str:
    return PLAIN.format(i=i, long=f"long text {i} " * 20, more=f"more {i} " * 30)


@pytest.mark.parametrize("n", [3, 12])
def test_a_wrapper_is_induced_without_names(spark, n):
    rows = [(i, f"http://h/{i}", plain(i)) for i in range(n)]
    want = {i: f"Title {i}\n\n{f'long text {i} ' * 20}".strip() + f"\n\n{f'more {i} ' * 30}".rstrip() for i in range(n)}
    assert extracted(spark, rows) == want
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    none = wrapper.induce(pages.limit(0))
    alone = {r.page_id: r.text for r in wrapper.extract_main_text(pages, wrappers=none).collect()}
    for i in range(n):
        assert alone[i] != want[i] and f"Word of day {i}" in alone[i] and "Same line" in alone[i]


def test_two_layouts_of_a_host_and_a_block_the_reference_lacks(spark):
    other = '<body><section class="x"><p>Shop notice for all.</p></section><main><p>Item {i} {long}</p></main></body>'
    rows = [(i, f"http://h/{i}", plain(i)) for i in range(6)]
    rows += [(100 + i, f"http://h/{i}", other.format(i=i, long=f"thing {i} " * 9)) for i in range(6)]
    # Only longer pages have the last line, in a place where a short reference has no node.
    page = "<body><article>{paragraphs}{tail}</article></body>"
    for i in range(40):
        many = i % 2 * 4 + 1
        rows.append((200 + i, f"http://k/{i}", page.format(paragraphs=f"<p>Paragraph {i} of words</p>" * many, tail="<div>Printed by the press.</div>" if many > 1 else "")))
    got = extracted(spark, rows)
    for i in range(6):
        assert got[i].startswith(f"Title {i}\n\nlong") and "Same line" not in got[i] and "Word of day" not in got[i]
        assert got[100 + i] == f"Item {i} " + f"thing {i} " * 8 + f"thing {i}"
    for i in range(40):
        assert got[200 + i] == "\n\n".join([f"Paragraph {i} of words"] * (i % 2 * 4 + 1))


def test_copies_of_one_article_are_no_template(spark):
    page = '<body><div class="top">Hello</div><article><h1>One</h1><p>{}</p><p>{}</p></article><footer>{}</footer></body>'
    rows = [(i, f"http://h/{i}", page.format("first " * 10, "second " * 10, i)) for i in range(20)]
    rows += [(50 + i, f"http://h/x{i}", page.format("first " * 10, f"other {i} " * 10, i)) for i in range(2)]
    got = extracted(spark, rows)
    first, second = ("first " * 10).strip(), ("second " * 10).strip()
    assert all(got[i] == f"One\n\n{first}\n\n{second}" for i in range(20))
    assert all(("other " + str(i)) in got[50 + i] for i in range(2))


def test_nulls_ties_names_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} of a long page</p>" for i in range(30_000)) + "</article>"
    wide = ["<article>" + "".join(f"<{'p' if (i * k) % 7 else 'pre'}>w{i}</{'p' if (i * k) % 7 else 'pre'}>" for i in range(3000)) + "</article>" for k in (1, 2, 3, 5)]
    rows = [(0, None, None), (1, "http://h/", ""), (None, "http://h/", "<p>no id"), (3, "http://l/", long), (3, "http://l/", long)]
    rows += [(10 + k, "http://w/", page) for k, page in enumerate(wide)]
    pages = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, layout long, host string")
    got = wrapper.extract_main_text(pages, ["page_id", "layout", "host", "html"]).collect()
    assert len(got) == len(rows) and {(r.layout, r.host) for r in got} == {(1, "h")}
    texts = sorted((r.page_id or -1, r.n_chars, r.text) for r in got)
    assert [t[2] for t in texts if t[0] == -1] == ["", "no id"] and [t[2] for t in texts if t[0] == 1] == [""]
    want = "\n\n".join(f"paragraph {i} of a long page" for i in range(30_000))
    assert [t[2] == want for t in texts if t[0] == 3] == [True, True]
    assert all(len(t[2].split("\n\n")) == 3000 for t in texts if t[0] >= 10)
    with pytest.raises(ValueError, match="clash"):
        wrapper.extract_main_text(pages.withColumnRenamed("host", "Text"), ["page_id", "Text"])


def test_votes_are_sums_over_pages(spark):
    """The summed votes against a count that walks all pages of one host here."""
    rows = [(i, f"http://h/{i}", plain(i % 4)) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = wrapper.induce(pages).collect()
    assert len(got) == 1
    root = wrapper.parse(got[0].reference)
    nodes = wrapper.numbered(root)
    same = {i for i, n in enumerate(nodes) if n.text == "Same line on every page."}
    assert set(got[0].places) == same and got[0].texts is None
    labels = {n.path: n.label for n in nodes}
    assert sorted(labels[p] for p in got[0].slots) == ["div a#", "div b", "div d"]
