"""Operators over a corpus against brute force: mixing, chat, near duplicates, suffix tree, wrappers, co-training, the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from recordloom.llm import chat, cotrain, mixing, near_dup, suffix_tree, wrapper
from recordloom.llm.prefix import running_sum

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_running_sum_spreads_a_hot_group(spark):
    rows = [("hot" if i % 3 else None if i % 2 else "b", (i * 7919) % 1000, i % 5) for i in range(600)]
    got = running_sum(spark.createDataFrame(rows, "g string, k long, v long"), ["k"], "v", "total", "g").collect()
    sums = collections.Counter()
    for r in sorted(got, key=lambda r: (str(r.g), r.k, r.total)):
        sums[r.g] += r.v
        assert r.total == sums[r.g]
    assert len(got) == 600


def test_targets_stop_and_reshare():
    sizes, weights = [100, 10, 1000, 0], [3, 1, 2, 3]
    got = mixing.fair_targets(sizes, weights, 1.5 * sum(sizes), 2)
    assert got[0] == 200 and got[1] == 20 and got[3] == 0 and math.isclose(sum(got), 1665)
    assert mixing.fair_targets([5, 5], [1, 1], 100, 2) == [10, 10] and mixing.fair_targets([], [], 0, 2) == []


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 9), ["b", "a", None, "a\U0001f600"][rng.choice([0, 0, 0, 1, 2, 3])], i) for i in range(500)]
    rows += [(1000, None, "a", 0), (1001, " ", "z", 0), (None, "n n", "a", 0), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    key = ["doc_id", "source", "text_hash", "takes"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = mixing.fair_targets([sizes[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)
    for s, t in zip(order, targets):
        own = got[got.source.isna() if s is None else got.source == s]
        assert math.isclose(own.target.iloc[0], t) and abs(own.taken.sum() - t) <= 9
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == got.takes.sum()
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_layouts_become_turns(spark):
    cases = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"completion":"c","prompt":"p"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', "conversations", [("user", "h"), ("assistant", "g")]),
        ('{"instruction":"i","input":"x","output":"o"}', "instruction_input_output", [("system", "i"), ("user", "x"), ("assistant", "o")]),
        ('{"zz":1}', None, None), ("{bad", None, None), (None, None, None), ('{"messages":[]}', None, None),
    ]
    rows = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "i int, j string, turns string")
    out = chat.canonical_turns(rows.withColumn("record", F.try_parse_json("j"))).select("i", "mapping", "turns").orderBy("i").collect()
    for r, (_, name, turns) in zip(out, cases):
        assert r.mapping == name and (r.turns and [(t.role, t.text) for t in r.turns]) == turns


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\<[\\\\[[<<SYS>>\\", "[/ROLE]\n</s>\n<s>", "a\\", "<|x|>"])
def test_template_is_reversible(text):
    template = chat.Template()
    turns = [("user", text), (text, "x" + text), ("assistant", text), ("assistant", "b")]
    formatted, spans = template.format(turns)
    assert template.read(formatted) == turns
    assert [template.unescaped(formatted[a:b]) for a, b in spans] == [text, "b"]
    assert not any(mark in template.escaped(text) for mark in ("</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "[ROLE]"))
    assert template.read(template.format([])[0]) == []


def test_chat_query(spark):
    from recordloom.llm.queries import op1_chat_format

    got = {r.conv_id: r for r in op1_chat_format(spark, SF).collect()}
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    assert set(got) == set(turns)
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, r, x in t if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in t).encode()).hexdigest()
        assert (got[c].loss_sha256, got[c].loss_chars, got[c].n_turns) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss), len(t))


def brute_classes(rows, k):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    over = {i: i for i in sets}

    def top(i):
        return i if over[i] == i else top(over[i])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                over[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k,small", [(2, None), (5, None), (2, 0)])
def test_near_duplicates(spark, monkeypatch, k, small):
    if small is not None:
        monkeypatch.setattr(near_dup, "SMALL", small)
        monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper().replace("W", "w")), (2, None), (3, ""), (4, " \n"), (5, "one"), (6, "ONE")]
    for i in range(10, 60):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(90)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    chain = list(base[:60]) + [f"c{i}" for i in range(60)]
    for i in range(100, 125):
        chain = chain[4:] + [f"{i} {j}" for j in range(2)]
        rows.append((i, " ".join(chain)))
    want = brute_classes(rows, k)
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows] + [(0, rows[0][1], "r")], "doc_id long, text string, component_id string").repartition(3)
    got = near_dup.near_duplicates(docs, shingle=k).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    if small is None:
        kept = near_dup.keep_representatives(docs, shingle=k)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[1] == i)
        assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_stragglers_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 2, raising=False)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(90)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, shingle=2).collect()} == brute_classes(rows, 2)


def test_stragglers_meet_in_buckets_only(spark):
    """Buckets that share a node make a chain; its ends share none, and are not compared."""
    import numpy as np

    sets = {n: np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in range(1, 4)}
    for x in sets.values():
        x.sort()
    regs = near_dup.registers_of(list(sets.values()))
    nodes = [(n, len(x), r.tobytes(), x.tobytes()) for (n, x), r in zip(sets.items(), regs, strict=True)]
    busy = spark.createDataFrame(nodes, "node long, n long, registers binary, elements binary")
    rooted = spark.createDataFrame([(b, 0, h, n, n) for b, h, ns in ((10, 7, (7, 1, 2)), (11, 8, (8, 2, 3))) for n in ns], "bucket long, band int, hub long, node long, root long")
    links = near_dup._straggler_links(rooted, busy.drop("elements"), busy.select("node", "elements"), 80)
    assert sorted(tuple(sorted(r)) for r in links.collect()) == [(1, 2), (2, 3)]


def test_representatives_under_one_id_or_none(spark):
    """Different texts under no id, or a repeated one, are judged each for itself."""

    def text(name):
        return " ".join(f"{name}{i}" for i in range(30))

    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (1, text("d")), (5, text("d")), (5, text("e")), (7, text("a"))]
    rows += [(None, ""), (None, None), (9, ""), (9, " "), (6, text("f")), (6, text("f")), (8, text("g")), (8, text("g").upper())]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    kept = near_dup.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, (r.text or "").strip().lower()) for r in kept.collect())
    want = [(7, text("a")), (None, text("b")), (None, text("c")), (1, text("d")), (5, text("e")), (6, text("f")), (8, text("g"))]
    assert got == collections.Counter([*want, (None, ""), (None, ""), (9, ""), (9, "")])


def test_contraction_equals_union_find(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, 201)]
    frame = spark.createDataFrame(edges, "u long, v long")

    def classes():
        found = collections.defaultdict(set)
        for r in near_dup.classes_of(frame).collect():
            found[r.root].add(r.id)
        return sorted(map(sorted, found.values()))

    plain = classes()
    monkeypatch.setattr(near_dup, "SMALL", 0)
    assert classes() == plain


@pytest.mark.parametrize("hot", [0, 300, 1 << 19])
def test_suffix_tree(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    rng = random.Random(3)
    rows = []
    for i in range(300):
        kind = i % 2
        rows.append((i, " ".join(rng.choice(["the", "of"] if kind else ["der", "von"]) + " " + rng.choice("abcdefg") + str(kind) for _ in range(30))))
    rows += [(1000, None), (1001, ""), (1002, "Unseen WORDS the"), (None, "the a1"), rows[0]]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = suffix_tree.score_documents(docs).collect()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    count = collections.Counter(x for i, t in rows if not held[i] for x in [*words(t), None])
    n, v = sum(count.values()), len(count)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        tokens = [*words(text[r.doc_id]), None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 5 and got[0].n_states > 3
    empty = suffix_tree.score_documents(docs.filter("doc_id = 1001 or doc_id is null and false")).collect()
    assert len(empty) == 1 and suffix_tree.score_documents(docs.limit(0)).count() == 0


def test_tree_keeps_the_same_contexts_at_any_size(spark):
    """A pair seen a few times counts however much other text there is, and the tables give what the model in one process gives."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    pair = [(10 + i, "rare pair seldom seen " * 2) for i in range(6)]
    noise = [(100 + i, " ".join(f"n{rng.randrange(60)}" for _ in range(60_000))) for i in range(24)]
    schema = "doc_id long, text string"
    out = {}
    for name, rows in {"small": pair, "large": pair + noise}.items():
        got = suffix_tree.score_documents(spark.createDataFrame(rows, schema)).collect()
        own = [r for r in got if r.doc_id < 100]
        assert all(r.score > r.base_score + 4 for r in own)
        out[name] = (rows, got)
    rows, got = out["large"]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    row, token = suffix_tree.token_stream(pa.RecordBatch.from_pydict({"text": train}))
    words, counts = np.unique(token, return_counts=True)
    often = counts >= suffix_tree.LEAST
    grams = suffix_tree.Grams(words[often], counts[often])
    for _ in range(suffix_tree.DEPTH):
        code, n = np.unique(grams.next_codes(row, token), return_counts=True)
        grams.codes.append(code[n >= suffix_tree.LEAST])
        grams.numbers.append(n[n >= suffix_tree.LEAST])
    tree = suffix_tree.grow(grams, int(counts.sum()), len(words))
    assert got[0].n_states == tree.states
    row, token = suffix_tree.token_stream(pa.RecordBatch.from_pydict({"text": [t for _, t in rows]}))
    want = dict(zip([i for i, _ in rows], np.bincount(row, tree.gains(row, token)), strict=True))
    assert all(math.isclose(r.score - r.base_score, want[r.doc_id], rel_tol=1e-6, abs_tol=1e-6) for r in got)


def test_tree_reads_the_texts_six_times(spark):
    """For their size, the words, the runs of two words, those of three with the parts of two, the parts of three, and the scores; ids once more."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, f"the same few words come again and again {i % 3}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(read, "doc_id long, text string")
    assert len(suffix_tree.score_documents(docs).collect()) == 20
    assert seen.value <= 7 * 20


def test_parts_of_a_run_come_from_one_task(spark):
    """One of the tasks that counted a run hands its parts on, not each; if rows move to other tasks meanwhile, no part is lost."""
    import numpy as np

    rows = [(" ".join(f"w{i}" for i in range(60)),)] * 24
    texts = spark.createDataFrame(rows, "text string").repartition(6)
    words = suffix_tree.count_words(texts)
    often = suffix_tree.count_runs(texts, 2, 3, words).select("bucket", "source", "key", "n")
    dealt = often.toPandas()
    assert len(dealt) == 61 and set(dealt["n"]) == {24} and dealt["source"].between(0, 5).all() and dealt["source"].nunique() > 3
    known = suffix_tree._filter(often.select("key", "source"))
    key = dealt["key"].to_numpy().view(np.uint64)
    senders = sum(known.has(suffix_tree.of_source(key, s)).astype(int) for s in range(6))
    assert senders.min() == 1 and senders.mean() < 1.2
    moved = often.selectExpr("bucket", "int(99) source", "key", "n")
    for kept in (often, moved):
        found = suffix_tree.count_runs(texts, 3, 3, kept, kept).toPandas()
        pairs = found[found["length"] == 2]
        context, suffix = (pairs[c].to_numpy().view(np.uint64) for c in ("context", "suffix"))
        assert len(pairs) == 61 and (suffix_tree.run_keys(context, suffix) == pairs["key"].to_numpy().view(np.uint64)).all()
        assert sorted(found[found["length"] == 3]["n"]) == [24] * 60


def test_filters_miss_no_key_and_hashes_are_packed():
    import numpy as np

    rng = np.random.default_rng(6)
    key = np.unique(rng.integers(0, 2**64, 16_000, dtype=np.uint64))
    words = np.zeros(1 << 12, np.uint64)
    code = suffix_tree.Filter.codes(key, len(words))
    np.bitwise_or.at(words, code >> np.uint64(18), suffix_tree.Filter.masks(code))
    known = suffix_tree.Filter(words)
    assert known.has(key).all() and known.has(rng.integers(0, 2**64, 50_000, dtype=np.uint64)).mean() < 0.03
    assert (suffix_tree._unpack(suffix_tree._pack(key), np.uint64) == key).all() and len(suffix_tree._pack(key)) < 7 * len(key)
    n = np.ones(len(key), np.uint32)
    assert (suffix_tree._unplanes(suffix_tree._planes(n), np.uint32) == n).all() and len(suffix_tree._planes(n)) < 100


@pytest.mark.parametrize("low", [0, 7 << 60])
def test_orders_and_places_of_hashes(low):
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5000):
        key = np.uint64(low) + rng.integers(0, 2**60 if low else 2**64, n, dtype=np.uint64)
        for x in (key, np.concatenate([key, key]), key >> np.uint64(50), key | np.uint64(1 << 20), np.sort(key)):
            assert (suffix_tree.order_of(x) == np.argsort(x, kind="stable")).all()
        # Hashes that only differ where places are kept.
        close = np.concatenate([np.array([0, 2**64 - 1], np.uint64), rng.permutation(64).astype(np.uint64)])
        assert (suffix_tree.order_of(close) == np.argsort(close, kind="stable")).all()
        known = np.unique(np.append(key[::2], [np.uint64(0), ~np.uint64(0)]))
        for table in (known, known[:-1], known[:0]):
            asked = np.concatenate([key, known, key + np.uint64(1)])
            assert (suffix_tree.Index(table).find(asked) == suffix_tree._find(table, asked)).all()


def test_span_hashes_are_sums_over_each_span():
    import numpy as np

    from recordloom.llm import words as w

    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 3 * w.HASH_BYTES, dtype=np.uint8)
    cuts = np.unique(np.append(rng.integers(0, w.HASH_BYTES, 300), [w.HASH_BYTES - 1, w.HASH_BYTES, w.HASH_BYTES + 9, len(data) - 5, len(data)]))
    starts, ends = np.append(cuts[:-1], len(data)), np.append(cuts[1:], len(data))
    got = w.span_hashes(data, starts, ends)
    for at in [0, 7, *range(len(starts) - 7, len(starts))]:
        part = data[starts[at] : ends[at]]
        total = int((w._LETTER[part] * w._powers(len(part))).sum(dtype=np.uint64)) + len(part) * 0xD6E8FEB86659FD93
        assert got[at] == w.mix(np.array([total % 2**64], np.uint64))[0]


def test_tree_is_a_distribution():
    """Over all words of the training text and one unseen, the probabilities after any context add up to at most 1, and nearly so."""
    import numpy as np

    rng = np.random.default_rng(1)
    token = np.sort(rng.integers(1, 2**63, 12).astype(np.uint64))
    grams = suffix_tree.Grams(token, rng.integers(50, 500, 12))
    pairs = sorted({(a, b) for a, b in rng.integers(0, 12, (40, 2))})
    grams.codes.append(np.array([a * 12 + b for a, b in pairs]))
    grams.numbers.append(np.array([max(2, int(grams.counts[a]) // 8) for a, _ in pairs]))
    n, v = int(grams.counts.sum()), 12
    tree = suffix_tree.grow(grams, n, v)
    for a in range(12):
        total = 0.0
        for b in range(12):
            gain = tree.gains(np.array([0, 0]), np.array([token[a], token[b]], np.uint64))[1]
            total += 10**gain * (grams.counts[b] + 1) / (n + v + 1)
        unseen = tree.gains(np.array([0, 0]), np.array([token[a], 5], np.uint64))[1]
        assert math.isclose(total + 10**unseen / (n + v + 1), 1, rel_tol=1e-6)


PAGE = (
    '<html><head><title>T{i}</title><style>p{{}}</style></head><body><header>Site</header><nav><a href="/">Home {i}</a></nav>'
    '<div class="ad">Buy {i}</div><div class="cookie-notice">We use cookies</div><{tag}><h1>Title {i} &amp; more</h1>'
    "<p>First <b>bold{i}<br>line\n two</p><p>Constant pitch, on every page.</p><p>Second &eacute; {i}</p><ul><li>item {i}</ul>"
    '</{tag}><aside>Side {i}</aside><form><input>Search</form><section id="comments"><p>I like {i}</p></section>'
    '<script>var t="</p>{i}";</script><!-- c {i} --><footer>&copy; {i}</footer></body></html>'
)


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers(spark, tag):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, tag=tag)) for i in range(30)]
    rows += [(100, None, "<p>Lone &lt;page&gt;"), (101, "http://x/", None), (102, "http://y/", ""), (103, "nonsense", "<div><p>a<p>b</div>"), rows[0]]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in wrapper.extract_main_text(pages).collect()}
    assert wrapper.extract_main_text(pages).count() == len(rows)
    for i in range(30):
        want = f"Title {i} & more\n\nFirst bold{i} line two\n\nSecond é {i}\n\nitem {i}"
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[100].text == "Lone <page>" and got[101].text == got[102].text == "" and got[103].text == "a\n\nb"
    assert wrapper.extract_main_text(pages.limit(0)).count() == 0


def test_tree_matching_pairs_equal_labels():
    a, b = wrapper.parse("<div><h1>x</h1><p>1</p><hr><p>2</p></div>"), wrapper.parse("<div><p>1</p><table></table><p>2</p></div>")
    pairs = [(x.tag, y.tag) for x, y in wrapper.matched(a, b)]
    assert all(x == y for x, y in pairs) and pairs.count(("p", "p")) == 2


def test_cotraining(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(["plain", "words", "in", "a", "row"]) + ("" if good else "!!") for _ in range(rng.randint(5, 80)))
        rows.append((i, text if good else text.upper(), "en", f"s{(0 if good else 5) + rng.randrange(6)}", len(text)))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", -5), rows[5]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (4, None, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.score_quality(docs, marks).collect()
    assert len(got) == len(rows)
    right = [r.kept == ("!!" not in rows[r.doc_id][1]) for r in got if r.doc_id < 600]
    assert sum(right) / len(right) > 0.99 and all(0 <= r.score <= 1 for r in got)
    kept = cotrain.keep_good(docs, marks)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    one = cotrain.score_quality(docs, marks.filter("quality = 1")).collect()
    assert all(r.kept and r.score is None for r in one)


def test_rules_stage_learns_from_the_whole_table(spark, tmp_path):
    """The first stage has removed all documents that are labelled bad; junk without a label still goes."""
    import corpus_pipeline

    good = "the quick brown fox jumps over a lazy dog while rain falls softly on the old town and people walk home slowly"
    bad = "zq##9 buy$$ now%% cheap&& pills|| win<< cash>> click## here$$ free** offer%% best&& deal|| act<< fast>> $$$1 ###2 %%%3 &&&4 |||5 <<<6 >>>7"
    rows = [(i, f"{good if i % 2 else bad} {i}") for i in range(60)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    left = whole.filter("doc_id >= 40 OR doc_id % 2 = 1")
    kept = corpus_pipeline.quality_rules(spark, left, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1, 60, 2))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("x"))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        path = corpus_pipeline.scratch(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == before.columns
        assert not set(r.doc_id for r in docs.select("doc_id").collect()) - set(r.doc_id for r in before.select("doc_id").collect())
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.filter("NOT round_trip").count() == 0 and last.count() == sizes[4]
    assert not any(labels.get(r.doc_id) == 0 for r in last.select("doc_id").collect())
    deduped = before.select("doc_id", "text").collect()
    classes = brute_classes([(r.doc_id, r.text) for r in deduped], 5)
    assert len({c for _, c in classes.values()}) == len(classes)
