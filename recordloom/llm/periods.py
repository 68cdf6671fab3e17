"""Periodic runs of words: seeds of guaranteed overlap, extended once along each lag of a document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import Words, mix, slices, texts_of

#: A run has at least LEAST words and REPEATS periods. So its words agree at a lag of its period q over max(LEAST - q, (REPEATS - 1) * q)
#: words, which is at least SEED for any q, and over 2 * SEED for q > SEED, over 4 * SEED for q > 2 * SEED and so on.
LEAST, REPEATS, SEED = 24, 3, 16
_FOLD = np.uint64(0xD1342543DE82EF95)


def _doubled(gram: np.ndarray, k: int) -> np.ndarray:
    """Names of the runs of 2k words from those of the runs of k words."""
    return mix(gram[: len(gram) - k] * _FOLD + gram[k:])


def runs_of(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(start, length, period)` of every run; `value` names the words of all texts, end to end, `row` the text of each. Starts index `value`.

    A run is a stretch with smallest period q and length >= max(LEAST, REPEATS * q) that no neighbouring word of its text extends.

    Level by level, k = SEED, 2 * SEED, ...: the k-grams of each text are indexed, and each occurrence is paired with the next one of the
    same text, if their lag q is one that the level answers for (k / 2 < q <= k; the first: q <= k). A run of such a period holds each
    of its k-grams again exactly q words later, and not sooner, as q is its smallest period; so one pair per occurrence finds all runs.
    Seeds are then ordered by text, lag and place. A seed that follows its predecessor directly lies in what that one's extension has
    covered, and only extends the reach of its lag; any other starts a run, since the word before it differs.
    """
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(value) < LEAST:
        return none, none, none
    gram, k = mix(value.astype(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 1
    while k < SEED and len(gram) > k:
        gram, k = _doubled(gram, k), 2 * k
    lowest, longest = 0, int(np.bincount(row).max())
    while len(gram) and REPEATS * (lowest + 1) <= longest:
        place = np.flatnonzero(row[: len(gram)] == row[k - 1 : k - 1 + len(gram)])
        own = gram[place]
        order = np.argsort(own, kind="stable")
        again = own[order[1:]] == own[order[:-1]]
        here, lag = place[order[:-1][again]], (place[order[1:]] - place[order[:-1]])[again]
        meant = (lag > lowest) & (lag <= k)
        here, lag = here[meant], lag[meant]
        if len(here):
            order = np.lexsort((here, lag, row[here]))
            here, lag = here[order], lag[order]
            head = np.ones(len(here), bool)
            head[1:] = (here[1:] != here[:-1] + 1) | (lag[1:] != lag[:-1])
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(here)) - 1
            start, period = here[first], lag[first]
            length = here[last] + k + period - start
            enough = length >= np.maximum(LEAST, REPEATS * period)
            found.append((start[enough], length[enough], period[enough]))
        gram, lowest, k = _doubled(gram, k) if len(gram) > k else gram[:0], k, 2 * k
    if not found:
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _repeating_rows(words: Words, value: np.ndarray) -> np.ndarray:
    """Whether each row has a run of SEED words twice: only those can hold a run."""
    gram, k = mix(value.astype(np.uint64) + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 1
    while k < SEED and len(gram) > k:
        gram, k = _doubled(gram, k), 2 * k
    hit = np.zeros(words.rows, bool)
    if k < SEED or len(gram) < 2:
        return hit
    place = np.flatnonzero(words.row[: len(gram)] == words.row[k - 1 : k - 1 + len(gram)])
    names = np.sort(gram[place])
    twice = np.unique(names[1:][names[1:] == names[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, gram[place]), len(twice) - 1)
        hit[words.row[place[twice[at] == gram[place]]]] = True
    return hit


def _planted(words: Words, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the word that stands in its place, and whether each row is changed: rows whose seed is a multiple of ten get a period."""
    n = words.counts().astype(np.int64)
    begin = np.cumsum(n) - n
    changed = (seed >= 0) & (seed % 10 == 0) & (n > 0)
    g = np.maximum(seed, 0) // 10
    a = np.where(changed, g % np.maximum(n, 1), n)
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(len(words.row)) - begin[words.row]
    from_a = at - a[words.row]
    return begin[words.row] + np.where(from_a >= 0, a[words.row] + from_a % p[words.row], at), changed


def _reports(part: pa.RecordBatch, plant: bool) -> dict[str, list]:
    texts = texts_of(part.column("text"))
    words = texts.words()
    rows = len(texts)
    seed = pc.fill_null(part.column("seed"), -1).to_numpy(zero_copy_only=False).astype(np.int64) if plant else np.full(rows, -1)
    stands, changed = _planted(words, seed)
    value = words.hash[stands]
    n = words.counts()
    begin = np.cumsum(n) - n
    some = np.flatnonzero(_repeating_rows(words, value)[words.row])
    start, length, period = runs_of(value[some], words.row[some])
    # Rows are whole in `some`, so a run is as long there as here.
    start = some[start] if len(start) else start
    gone = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    gone = np.cumsum(gone)[:-1] > 0
    edge = np.searchsorted(words.row[start] if len(start) else start, np.arange(rows + 1))
    out: dict[str, list] = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for r in range(rows):
        own = slice(edge[r], edge[r + 1])
        runs = list(zip((start[own] - begin[r]).tolist(), length[own].tolist(), period[own].tolist(), strict=True))
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None, None, None)
        text = texts.data[texts.offsets[r] : texts.offsets[r + 1]].tobytes().split()
        if runs or changed[r]:
            keep = stands[begin[r] : begin[r] + n[r]][~gone[begin[r] : begin[r] + n[r]]] - begin[r]
            text = [text[i] for i in keep.tolist()]
        out["n_runs"].append(len(runs))
        for name, x in zip(("start", "length", "period"), best, strict=True):
            out[name].append(x)
        out["exponent_milli"].append(1000 * best[1] // best[2] if runs else None)
        out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(b" ".join(text)).hexdigest())
    return out


def periodic_runs(docs: DataFrame, keep: list[Column | str], seed: Column | None = None) -> DataFrame:
    """`keep`, n_runs, the run of greatest length over period, digests of all runs and of the text without repetitions; a row per row of `docs`.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, compared as 64-bit hashes within a text. `start` to `exponent_milli` are null without a
    run; of equal exponents the smallest start, then period, counts. Null and empty texts have no words. Given `seed`, texts whose seed is a
    multiple of ten are first made periodic from a place and with a period that follow from it (null: left as they are).
    The work on a text is n log n in its words and never leaves its task.
    """
    given = docs.select(*keep)
    names = [f"k{i}" for i in range(len(given.columns))]
    kinds = [f.dataType.simpleString() for f in given.schema.fields]
    plant = seed is not None
    source = docs.select(*[c if isinstance(c, Column) else F.col(f"`{c}`") for c in keep], F.col("text"), (seed if plant else F.lit(None)).cast("long"))
    source = source.toDF(*names, "text", "seed")
    numbers, digests = ["n_runs", "start", "length", "period", "exponent_milli"], ["runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = _reports(part, plant)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], *[pa.array(out[c], pa.int64()) for c in numbers], *[pa.array(out[c], pa.string()) for c in digests]],
                    [*names, *numbers, *digests],
                )

    shape = [f"{c} {t}" for c, t in zip(names, kinds, strict=True)] + [f"{c} long" for c in numbers] + [f"{c} string" for c in digests]
    return source.mapInArrow(run, ", ".join(shape)).toDF(*given.columns, *numbers, *digests)


def contract_seed() -> Column:
    """The CRC-32 of the decimal doc_id; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))
