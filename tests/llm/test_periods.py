"""Periodic runs against the definition, period by period."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import periods
from recordloom.llm.queries import QUERIES


def brute_runs(words):
    """Every maximal stretch of each period, if no smaller period holds on it."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        at = 0
        for i, x in enumerate(same):
            if x:
                continue
            length = i - at + q
            if i > at and length >= max(24, 3 * q):
                part = words[at : at + length]
                if not any(all(part[j] == part[j + p] for j in range(length - p)) for p in range(1, q)):
                    out.append((at, length, q))
            at = i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    if runs:
        s, length, q = runs[0]
        for r in runs[1:]:
            if r[1] * q > length * r[2]:
                s, length, q = r
        best = (s, length, q, 1000 * length // q)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, digest("".join(f"{s},{x},{q}\n" for s, x, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def hard_texts(rng):
    words = lambda n, k: [f"{rng.randrange(k)}" for _ in range(n)]
    out = [words(rng.randint(0, 150), rng.choice([1, 2, 3, 50])) for _ in range(60)]
    for q in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 47, 64, 65):
        for length in (max(24, 3 * q) - 1, max(24, 3 * q), max(24, 3 * q) + 1, 5 * q + 30):
            unit = words(q, 4)
            out.append(words(rng.randint(0, 9), 9) + [unit[i % q] for i in range(length)] + words(rng.randint(0, 9), 9))
    unit = words(20, 3)
    # A phrase that returns inside the period, runs inside runs, and runs that overlap.
    nested = (unit + ["x"] + unit + ["y"] * 30 + unit) * 4
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    return out + [nested, fib[-1], (["a"] * 30 + ["b"]) * 5, nested[:150] + unit * 6]


def test_runs_against_the_definition():
    for words in hard_texts(random.Random(5)):
        value = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8]) for w in words], np.uint64)
        got = periods.runs_of(value, np.zeros(len(words), np.int64))
        assert list(zip(*(x.tolist() for x in got))) == brute_runs(words), words


def test_reports_against_the_definition(spark):
    rng = random.Random(6)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60] + list(range(5000, 5100))
    texts = [" ".join(w) for w in hard_texts(rng)]
    rows = [(i, (texts[k % len(texts)] or None) if k % 9 else "A a\t b \U0001f600\n" * 5, k, "s") for k, i in enumerate(ids)]
    rows += [(None, "z " * 30, 0, "s"), (1, None, 0, "s"), (1, "", 0, "s"), (2, " \n", 0, "s"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period int, start string")
    got = periods.periodic_runs(docs.repartition(3), ["doc_id"], periods.contract_seed()).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_report(r[0], r[1])) for r in rows)
    plain = periods.periodic_runs(docs.filter("doc_id IS NULL"), ["doc_id", F.col("period").alias("k")]).collect()
    assert [(r.k, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in plain] == [(0, 1, 0, 30, 1, 30000)]
    assert periods.periodic_runs(docs.limit(0), ["doc_id"], periods.contract_seed()).count() == 0


def test_very_long_text(spark):
    """One text of 300 000 words with a long period; the runs are known without a search."""
    rng = random.Random(1)
    unit = [str(rng.getrandbits(60)) for _ in range(40_000)]
    text = " ".join(unit + unit + unit + unit[:5] + [f"_{i}" for i in range(100_000)] + ["end"] * 50_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = periods.periodic_runs(docs, ["doc_id"]).collect()[0]
    assert (got.n_runs, got.start, got.length, got.period) == (2, 220_005, 50_000, 1)
    want = "0,120005,40000\n220005,50000,1\n"
    assert got.runs_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_query_on_the_sample(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = [d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(docs)
    for d in docs:
        if len((d.text or "").split()) <= 400:
            assert got[d.doc_id] == brute_report(d.doc_id, d.text)
