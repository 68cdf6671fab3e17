"""Row-local operators against brute force: words, rules, BPE, fingerprints, languages."""

import collections
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import bpe, edit_prints, language, rules
from recordloom.llm.words import Texts, slices, texts_of

SPACE = " \t\n\x0b\x0c\r"
TEXT = st.text(alphabet=st.sampled_from([*"abAB#*|é漢🙂", *SPACE, "\x1c", "\x85", "\xa0"]), max_size=60)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def column(texts):
    return pa.array(texts, pa.string())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    found = texts_of(column(texts))
    words = found.words()
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    got = [(int(r), bytes(found.data[a:b]).decode()) for r, a, b in zip(words.row, words.starts, words.ends)]
    assert got == want
    by_hash = {}
    for (_, w), h in zip(want, words.hash):
        assert by_hash.setdefault(int(h), w) == w
    assert len(by_hash) == len({w for _, w in want})


def test_a_long_word_and_sliced_arrays():
    texts = ["x" * 5_000_000, "a b", None, ""]
    whole = texts_of(column(texts)).words()
    part = texts_of(column(texts).slice(1)).words()
    assert list(whole.hash[1:]) == list(part.hash) and list(part.row) == [0, 0]
    batch = pa.RecordBatch.from_arrays([column(texts)], ["text"])
    assert sum(s.num_rows for s in slices(batch)) == 4
    assert list(slices(batch.slice(0, 0))) == []


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, min_size=1, max_size=6), st.integers(1, 6))
def test_rule_counts(texts, times):
    texts = [t and (t + "\n") * times for t in texts]
    found = texts_of(column(texts))
    got = rules.rule_counts(found, found.words())
    assert [tuple(int(v[i]) for v in got.values()) for i in range(len(texts))] == [brute_rules(t) for t in texts]


def test_features_do_not_depend_on_neighbours():
    texts = ["the cat sat on the mat", "", "x", "Ünï cödé!!"]
    together = texts_of(column(texts))
    whole = rules.ngram_features(together, together.words())
    for i, t in enumerate(texts):
        alone = texts_of(column([t]))
        assert np.allclose(whole[i], rules.ngram_features(alone, alone.words())[0])


def test_rules_in_spark(spark):
    good = " ".join(f"plain{i} words" for i in range(15))
    bad = " ".join(f"W{i}!! *** %%%" for i in range(15))
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(60)] + [(100, None), (101, ""), (102, "short")]
    docs = spark.createDataFrame(rows + [(1, rows[1][1])], "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as n_words")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = rules.apply_rules(docs, rules.fit_rules(docs, labels), ["doc_id"]).toPandas()
    assert len(out) == 64
    kept = out[out.doc_id < 60]
    assert (kept.kept == (kept.doc_id % 2 == 1)).all()
    assert not out[out.doc_id >= 100].kept.any() and out[out.doc_id >= 100].base_failed.all()
    assert rules.fit_rules(docs, labels.filter("quality = 1")) is None
    plain = rules.apply_rules(docs, None, ["doc_id"]).toPandas()
    assert plain.quality.isna().all() and (plain.kept == ~plain.base_failed).all()
    assert rules.keep_by_rules(docs, None).columns == docs.columns
    assert rules.apply_rules(docs.limit(0), None, ["doc_id"]).count() == 0


def test_calibration_does_not_depend_on_the_sample(spark):
    """A tenth of the labels is bad and the text does not tell: every probability is near 0.9, however few rows are taken of each class."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(30)), int(i % 10 > 0)) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000 + i, 0) for i in range(3000)], "doc_id long, quality int")
    for most in (6000, 200):
        model = rules.fit_rules(docs, labels, max_rows=most)
        mean = rules.apply_rules(docs, model, ["doc_id"]).agg({"quality": "avg"}).first()[0]
        assert abs(mean - 0.9) < 0.05


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(*bpe.vocabulary_path())


@pytest.fixture(scope="module")
def reference(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=80) | TEXT, max_size=5))
def test_bpe_equals_the_library(vocabulary, reference, texts):
    encoder = bpe.Encoder(vocabulary, "test")
    for text, ids in zip(texts, encoder.encode(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 900 + " " * 400, "<|endoftext|> x", "\U00010944딯셡\U00010944", "don't 'll they've", "１２３ ٣ ½"])
def test_bpe_hard_texts(vocabulary, reference, text):
    ids = bpe.Encoder(vocabulary, "hard").encode([text])[0]
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference.encode_ordinary(text)


def test_bpe_in_spark(spark, reference):
    texts = ["Hello world, hello!", None, "", "Grüße  aus\nKöln"]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)] + [(0, texts[0], b"y")], "doc_id long, text string, ids binary")
    out = bpe.digests(bpe.encode_documents(docs, *bpe.vocabulary_path(), ["doc_id"]), ["doc_id"]).toPandas()
    assert len(out) == 5
    for r in out.itertuples():
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_fold_in_sql(spark, reference):
    words = spark.createDataFrame([(w,) for w in ["hello", " lower", "xqzj", "é"]], "word string")
    got = bpe.fold_in_sql(words, *bpe.vocabulary_path()).collect()
    assert all(r["ids"] == reference.encode_ordinary(r["word"]) for r in got)


def brute_walk(text):
    symbols = edit_prints.symbols()
    p, i, out = 0, 0, np.zeros(edit_prints.SAMPLES, np.uint8)
    marks = edit_prints.sampled_steps(1 << 16)
    while p < len(text):
        s = symbols[ord(text[p])]
        if i in marks:
            out[marks[i]] = edit_prints._sample(np.array([s]), i, marks[i])[0]
        p += edit_prints.ADVANCE[i % edit_prints.PERIOD, s]
        i += 1
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, max_size=40))
def test_walks(texts):
    got = edit_prints.fingerprints(texts) if texts else []
    for t, row in zip(texts, got):
        assert (row == brute_walk(t)).all()


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("etaoin shrdlu"), 3000))
    other = "".join(rng.choice(list("etaoin shrdlu"), 3000))
    one = text[:1500] + "x" + text[1500:]
    half = edit_prints.edited(text, other)
    a, b, c, d, e = edit_prints.fingerprints([text, one, half, other, text])
    assert (a == e).all() and edit_prints.likeness(a, b) > 0.85
    assert 0.4 < edit_prints.likeness(a, c) < 0.75 and edit_prints.likeness(a, d) < 0.25


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_fingerprints_in_spark(spark, n):
    texts = [None if i % 7 == 3 else "" if i % 7 == 4 else f"text {i} " * (i % 5 + 1) for i in range(n)]
    rows = [(None if i == 5 else 2 * i, t, "z") for i, t in enumerate(texts)] + ([(8, texts[4], "z")] if n > 8 else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    out = edit_prints.fingerprint_documents(docs).toPandas()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    after = {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}
    prints = collections.defaultdict(set)
    for r in out.itertuples():
        doc = None if np.isnan(r.doc_id) else int(r.doc_id)
        text = next(t or "" for i, t, _ in rows if i == doc)
        changed = edit_prints.edited(text, after[doc])
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert bytes.fromhex(r.fingerprint) == edit_prints.fingerprints([text])[0].tobytes()
        assert bytes.fromhex(r.edited_fingerprint) == edit_prints.fingerprints([changed])[0].tobytes()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        prints[text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_languages(spark):
    rng = np.random.default_rng(5)
    kinds = {"aa": ["ba", "na", "la", "ka"], "oo": ["xo", "zu", "qo", "vu"]}
    rows = []
    for i in range(120):
        lang = ["aa", "oo"][i % 2]
        rows.append((i, " ".join("".join(rng.choice(kinds[lang], 3)) for _ in range(20)), lang))
    rows += [(200, None, "aa"), (201, "", None), (202, "123 !?", "oo"), (203, "bananala", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    profiles = language.fit_profiles(docs.filter(~language.held_out()))
    out = language.identify(docs, profiles, ["doc_id", language.held_out().alias("held_out")]).toPandas().set_index("doc_id")
    assert all(out.lang_pred[i] == lang for i, _, lang in rows[:120]) and out.score.between(0, 1).all()
    assert list(out.lang_pred[[200, 201, 202]]) == ["und"] * 3 and out.lang_pred[203] == "aa"
    nothing = language.fit_profiles(docs.limit(0))
    assert set(language.identify(docs, nothing, ["doc_id"]).toPandas().lang_pred) == {"und"}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_bundles_are_sums_of_bound_letters(texts):
    vectors, has = language.bundles(texts)
    for t, v, h in zip(texts, vectors, has):
        low = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        low = re.sub(" +", " ", low)
        assert h == any(c.isalpha() for c in low)
        codes = np.array([ord(c) for c in low], np.int64)
        total = language.gram_vectors(codes[:-2], codes[1:-1], codes[2:]).sum(0) if h else np.zeros(language.DIM)
        assert np.allclose(v, total / max(np.linalg.norm(total), 1e-9), atol=1e-5)


def test_texts_dataclass():
    assert len(Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64)).words().hash) == 0
