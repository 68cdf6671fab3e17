"""SimHash classes against all pairs; the covering masks against all pairs of bits."""

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from recordloom.llm import simhash
from recordloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    """For each position the least position that links reach."""
    over = list(range(len(prints)))

    def top(i):
        while over[i] != i:
            i = over[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((top(i), top(j)))
            over[b] = a
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_choice_of_bits(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        gone = sum(1 << b for b in bits)
        assert any(not m & gone for m in masks)
    assert min(m.bit_count() for m in masks) >= 30


def test_fingerprints_bit_by_bit():
    texts = ["", " \t\n", "One", "one two", "A b C d", "x " * 50, "Été   naïve \U0001f600 İ", "a\x0bb\x0cc\x1cd e", " ".join(str(i % 91) for i in range(70_000))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("most", [256, 2, 1])
def test_links_among_clustered_fingerprints(spark, most):
    """Chains, stars and dense balls of fingerprints; with most = 1 every shared bucket goes by centres."""
    rng = random.Random(11)
    prints = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 25])):
            prints.add(at)
            at ^= sum({1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 2, 3]))})
    ball = rng.getrandbits(64)
    prints |= {ball ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {0, 1, 1 << 63, 2**64 - 1}
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    for radius in (1, 2):
        links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"), radius, most).collect()
        want = brute_classes(prints, radius)
        where = {p: i for i, p in enumerate(signed)}
        over = list(range(len(prints)))

        def top(i):
            while over[i] != i:
                i = over[i]
            return i

        for u, v in links:
            a, b = sorted((top(where[u]), top(where[v])))
            over[b] = a
        assert [top(i) for i in range(len(prints))] == want


def test_documents_against_all_pairs(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["red", "Oak", "sea", "ü", "9", "lid", "fog"]) for _ in range(rng.randint(30, 300))) for _ in range(60)]
    texts = base + [t + " end" for t in base] + [t.replace(" Oak", "  OAK", 2) for t in base] + [None, "", " ", "w", "w w"] * 3
    rng.shuffle(texts)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string, root int")
    got = {r.doc_id: r for r in simhash.similar_documents(docs, most=3).collect()}
    prints = [brute_print(t) for t in texts]
    classes = brute_classes(prints, 2)
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == classes[i]
    assert {r.doc_id for r in got.values() if r.component_id == classes[texts.index(None)]} >= {i for i, t in enumerate(texts) if not (t or "").strip()}


def test_repeated_null_and_text_ids(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "zz"), (5, "zz"), (None, "lone words here"), (9, "A B C D")]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("5", "5")] * 3 + [("9", "5"), ("None", "5"), ("None", "None")]
    named = spark.createDataFrame([("b", "x y z"), ("a", "x y z")], "doc_id string, text string")
    assert {r.component_id for r in simhash.similar_documents(named).collect()} == {"a"}
    assert simhash.similar_documents(named.limit(0)).count() == 0


def test_query_on_the_sample(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op12_simhash_covering"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.col("doc_id")).collect()
    prints = [brute_print(d.text) for d in docs]
    classes = brute_classes(prints, 2)
    assert [got[d.doc_id].fingerprint for d in docs] == [f"{p:016x}" for p in prints]
    assert [got[d.doc_id].component_id for d in docs] == [docs[i].doc_id for i in classes]
