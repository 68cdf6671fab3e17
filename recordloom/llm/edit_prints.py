"""Document fingerprints by a randomised edit embedding: shared walks over characters, then bit sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.words import mix
from recordloom.session import cut_lineage

#: Samples of a fingerprint, one byte each; bands of ROWS samples.
SAMPLES, ROWS = 128, 4
#: Steps after which the random bits of the walk repeat.
PERIOD = 4096
#: Code points of texts that are walked together, and the number of texts below which each is walked alone.
GROUP = 6 << 20
ALONE = 24
#: The longest walk whose sampled steps are prepared; steps double when a longer one comes.
FIRST_STEPS = 1 << 20

_rng = np.random.Generator(np.random.PCG64(99))
#: Bit by step and symbol; symbol 0 ends a text and stays where it is.
ADVANCE = _rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
ADVANCE[:, 0] = 0
_DRAWS = np.random.Generator(np.random.PCG64(100)).random((64, SAMPLES))


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """A symbol 1..255 for each code point."""
    return (mix(np.arange(0x110000, dtype=np.uint64)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


@lru_cache(maxsize=8)
def sampled_steps(upto: int) -> dict[int, np.ndarray]:
    """Samples taken at a step below `upto`, by step.

    A sample of a walk of m steps is the step of least priority below m in a shared random order. Each is a record of that order,
    and after a record at t the next lies beyond s with probability (t + 1) / (s + 1): so the records are drawn directly,
    and walks of like length take their samples at the same steps.
    """
    step, out = np.zeros(SAMPLES, np.int64), {0: np.arange(SAMPLES)}
    for draw in _DRAWS:
        step = np.minimum((step + 1) / draw, 2.0**61).astype(np.int64)
        for at in np.unique(step[step < upto]):
            out[int(at)] = np.union1d(out.get(int(at), np.zeros(0, np.int64)), np.flatnonzero(step == at))
    return out


def _sample(symbol: np.ndarray, step: int, bins: np.ndarray) -> np.ndarray:
    """One byte from a symbol, its step and its sample; 0 is left for texts without a character."""
    value = mix(symbol.astype(np.uint64)[:, None] + np.uint64(step % 2**40) * np.uint64(256) + (bins.astype(np.uint64) << np.uint64(50)))
    return (value % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SAMPLES bytes for each text; equal texts have equal rows, the empty text zeros.

    At step i the walk stands on a character, which is the i-th symbol of the embedding, and moves on if the random bit of
    (i, character) is set, until the text ends. Texts that differ by an insertion meet again after some steps.
    """
    coded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(c) for c in coded], np.int64)
    start = np.cumsum(size + 1) - size - 1
    data = np.zeros(int((size + 1).sum()), np.uint8)
    for s, c in zip(start, coded, strict=True):
        data[s : s + len(c)] = symbols()[c]
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    live = np.flatnonzero(size)
    at = start[live].copy()
    limit, step = FIRST_STEPS, 0
    marks = sampled_steps(limit)
    flat = ADVANCE.ravel()
    while len(live) >= ALONE:
        for _ in range(256):
            symbol = data[at]
            bins = marks.get(step)
            if bins is not None:
                on = np.flatnonzero(symbol)
                out[np.ix_(live[on], bins)] = _sample(symbol[on], step, bins)
            at += flat[(step % PERIOD) * 256 + symbol.astype(np.int64)]
            step += 1
            if step >= limit:
                limit *= 2
                marks = sampled_steps(limit)
        more = data[at] != 0
        live, at = live[more], at[more]
    table = [row.tobytes() for row in ADVANCE] if len(live) else []
    for text, place in zip(live, at, strict=True):
        own = data[place : start[text] + size[text] + 1].tobytes()
        p, i, top, due = 0, step, limit, marks
        while symbol := own[p]:
            if i in due:
                out[text, due[i]] = _sample(np.array([symbol]), i, due[i])[0]
            p += table[i % PERIOD][symbol]
            i += 1
            if i >= top:
                top *= 2
                due = sampled_steps(top)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples of two fingerprints (rows)."""
    return (a == b).mean(-1)


def bands(prints: np.ndarray) -> np.ndarray:
    """Bit-sampled bands: texts whose walks mostly agree share one; (rows, SAMPLES / ROWS) unsigned 32-bit keys."""
    return np.ascontiguousarray(prints).view("<u4")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long"


def _compared(texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    new = fingerprints(changed)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
        pa.array([r.tobytes().hex() for r in own], pa.string()),
        pa.array([r.tobytes().hex() for r in new], pa.string()),
        pa.array(likeness(own, new)),
        pa.array(likeness(own, after)),
        pa.array((bands(own) == bands(new)).sum(1), pa.int64()),
    ]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited.

    The next document is the next row by doc_id (null first; equal ids by a hash of the text), after the last the first; a single row is its
    own next. Null texts are empty; two empty texts have likeness 1, an empty and another 0 (no sample of a text is zero). `bands_edited` is the number of bands that
    the text and its edited text share: with one, banding would find the pair, and `near_edited` verifies it.

    The texts are range-sorted once. A task walks its rows in groups, and hands on the first and the last row of its range;
    these, two for each range, are then joined to their neighbours.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f.split()[0] for f in FIELDS.split(", ")], "range", "place", "text"]

    def rows_of(ids: list, columns: list[pa.Array] | None, place: str | None, texts: list[str] | None, id_type: pa.DataType) -> pa.RecordBatch:
        n = len(ids)
        part = TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        values = columns or [pa.nulls(n, k) for k in kinds]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), *values, pa.array([part] * n, pa.int32()), pa.array([place] * n, pa.string()), pa.array(texts or [None] * n, pa.string())], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        id_type, held = None, 0
        first = True

        def done() -> pa.RecordBatch:
            own = fingerprints(texts)
            return rows_of(ids[:-1], _compared(texts[:-1], texts[1:], own[:-1], own[1:]), None, None, id_type)

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                if first:
                    yield rows_of([doc], None, "first", [text], id_type)
                    first = False
                held += len(text)
                if held > GROUP and len(texts) > 1:
                    yield done()
                    ids, texts, held = ids[-1:], texts[-1:], len(text)
        if len(texts) > 1:
            yield done()
        if texts:
            yield rows_of(ids[-1:], None, "last", texts[-1:], id_type)

    made = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {FIELDS}, range int, place string, text string"
    )
    made = cut_lineage(made)
    # One row per range, of numbers only.
    ranges = made.filter("place = 'first'").select("range")
    order = Window.orderBy("range")
    follows = ranges.select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(order)).alias("after"))
    last = made.filter("place = 'last'").select("doc_id", "text", "range").join(follows, "range")
    heads = made.filter("place = 'first'").select(F.col("text").alias("following"), F.col("range").alias("after"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column("text").to_pylist(), batch.column("following").to_pylist()
                both = fingerprints(a + b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *_compared(a, b, both[: len(a)], both[len(a) :])], names[:-3]
                )

    ends = last.join(heads, "after").select("doc_id", "text", "following").mapInArrow(finish, f"doc_id {kind}, {FIELDS}")
    return made.filter("place is null").select(*names[:-3]).unionByName(ends)
