"""Quality rules: counted rules, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.linear import fit_logistic, fit_platt, sigmoid
from recordloom.llm.words import SEPARATOR, Texts, Words, mix, slices, span_hashes, texts_of
from recordloom.session import cut_lineage

#: Hashed dimensions of character trigrams, words and word pairs.
CHAR_DIM, WORD_DIM, PAIR_DIM = 1024, 512, 512
DIM = CHAR_DIM + WORD_DIM + PAIR_DIM
#: Bytes whose trigrams are hashed at once.
SEGMENT = 1 << 19
#: Words of a window that must not come twice.
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BREAK = np.zeros(256, bool)
BREAK[0x0A] = True


@dataclass
class RuleModel:
    """Coefficients (the intercept last), the calibration of the score and the threshold on the probability."""

    beta: np.ndarray
    a: float
    b: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * (x @ self.beta[:-1].astype(np.float32) + self.beta[-1]) + self.b)


def repeated(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its value comes more than once in its row, and whether it came earlier (items are in order)."""
    order = np.lexsort((np.arange(len(value)), value, row))
    same = np.zeros(len(value), bool)
    if len(value) > 1:
        a, b = order[:-1], order[1:]
        same[1:] = (row[a] == row[b]) & (value[a] == value[b])
    again, twice = np.zeros(len(value), bool), np.zeros(len(value), bool)
    again[order] = same
    pair = same.copy()
    pair[:-1] |= same[1:]
    twice[order] = pair
    return twice, again


def rule_counts(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row, over the whole text."""
    n = len(texts)
    # Code points are the bytes that do not continue one.
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    chars = np.bincount(words.row, points[words.ends] - points[words.starts], n).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[texts.data])])
    symbols = marks[texts.offsets[1:]] - marks[texts.offsets[:-1]]
    first, window = words.windows(WINDOW)
    twice, _ = repeated(words.row[first], window)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    covered = np.bincount(words.row, np.cumsum(cover)[:-1] > 0, n).astype(np.int64)
    starts, ends = texts.runs(BREAK)
    seen = np.concatenate([[0], np.cumsum(~SEPARATOR[texts.data])])
    worded = seen[ends] > seen[starts]
    starts, ends = starts[worded], ends[worded]
    line_row = texts.rows_of(starts)
    _, again = repeated(line_row, span_hashes(texts.data, starts, ends))
    return {
        "n_words": words.counts(),
        "word_chars": chars,
        "n_symbols": symbols.astype(np.int64),
        "n_dup_lines": np.bincount(line_row, again, n).astype(np.int64),
        "n_repeat_words": covered,
    }


def ngram_features(texts: Texts, words: Words) -> np.ndarray:
    """Rows of hashed counts, damped by a root and scaled to length 1 in each of the three parts.

    Byte trigrams carry characters and marks; a pair of equal words is one and the same feature whatever the word.
    """
    n = len(texts)
    out = np.zeros((n, DIM), np.float32)
    for at in range(0, len(texts.data) - 2, SEGMENT):
        data = texts.data[at : at + SEGMENT + 2].astype(np.uint32)
        gram = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x2C1B3C6D)
        bucket = (gram >> np.uint32(22)).astype(np.int64)
        # A trigram counts for the row of its first byte, if it ends in the same row.
        ends = np.maximum(texts.offsets[1:] - 2, texts.offsets[:-1])
        lo, hi = (np.clip(v, at, at + len(bucket)) - at for v in (texts.offsets[:-1], ends))
        inside = np.zeros(len(bucket) + 1, np.int64)
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        inside = np.cumsum(inside)[:-1] > 0
        key = np.repeat(np.arange(n), hi - lo) * CHAR_DIM + bucket[inside]
        out[:, :CHAR_DIM] += np.bincount(key, minlength=n * CHAR_DIM).reshape(n, CHAR_DIM)
    if len(words.hash):
        at = (words.hash >> np.uint64(40)).astype(np.int64) % WORD_DIM
        out[:, CHAR_DIM : CHAR_DIM + WORD_DIM] = np.bincount(words.row * WORD_DIM + at, minlength=n * WORD_DIM).reshape(n, WORD_DIM)
    if len(words.hash) > 1:
        together = np.flatnonzero(words.row[:-1] == words.row[1:])
        a, b = words.hash[together], words.hash[together + 1]
        at = (mix(a * np.uint64(31) + b) >> np.uint64(40)).astype(np.int64) % (PAIR_DIM - 1) + 1
        at[a == b] = 0
        out[:, CHAR_DIM + WORD_DIM :] = np.bincount(words.row[together] * PAIR_DIM + at, minlength=n * PAIR_DIM).reshape(n, PAIR_DIM)
    np.sqrt(out, out=out)
    for lo, hi in ((0, CHAR_DIM), (CHAR_DIM, CHAR_DIM + WORD_DIM), (CHAR_DIM + WORD_DIM, DIM)):
        length = np.linalg.norm(out[:, lo:hi], axis=1, keepdims=True)
        out[:, lo:hi] /= np.where(length > 0, length, 1)
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = texts_of(part.column("text"))
            x = ngram_features(texts, texts.words()).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [part.column("_h"), part.column("_y"), part.column("_fold"), pa.array([r.tobytes() for r in x], pa.binary())],
                ["id", "y", "fold", "x"],
            )


def class_weights(y: np.ndarray, total: dict[int, int]) -> np.ndarray:
    """Of each row the share of its class among all labels over its share among these rows; the weights add up to the rows."""
    weight = np.where(y > 0, total[1] / max(1, (y > 0).sum()), total[0] / max(1, (y <= 0).sum()))
    return weight * len(y) / weight.sum()


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, threshold: float = 0.5) -> RuleModel | None:
    """Fit on at most `max_rows` labelled rows, half of each label at most, chosen by a hash of doc_id.

    A fifth of them calibrates the score, each weighing as many labels of its class as it stands for, so that a probability means the
    same share of all labels whatever the sample. Labels that are null or disagree on a document, or whose document is not in
    `docs`, are left out. None if a label is missing: then only the counted rules decide.
    """
    seen = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_y"), F.max("quality").alias("_most"))
        .filter("_y = _most")
    )
    seen = seen.join(docs.select("doc_id"), "doc_id", "left_semi")
    hashed = cut_lineage(seen.select(F.col("doc_id").alias("_id"), F.col("_y").cast("int"), F.xxhash64("doc_id").alias("_h")))
    # Of all labels, not of the chosen ones.
    total = {r["_y"]: r["n"] for r in hashed.filter("_y in (0, 1)").groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = [hashed.filter(F.col("_y") == y).orderBy("_h", "_id").limit(max_rows // 2) for y in (0, 1)]
    # max_rows rows at most.
    chosen = F.broadcast(each[0].unionByName(each[1]).withColumn("_fold", F.pmod("_h", F.lit(5)).cast("int")))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    rows = rows.select("_h", "text", "_y", "_fold").mapInArrow(_feature_rows, "id long, y int, fold int, x binary")
    found = rows.groupBy("id", "y", "fold").agg(F.min("x").alias("x")).collect()
    if len({r["y"] for r in found}) < 2:
        return None
    # Ordered by value, so that the sums do not depend on the order of arrival.
    found.sort(key=lambda r: (r["fold"], r["y"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32)
    y, fold = np.array([r["y"] for r in found], float), np.array([r["fold"] for r in found])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    held = fold == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    beta = fit_logistic(x[~held], y[~held], weight[~held])
    check = held if held.any() else ~held
    a, b = fit_platt(x[check] @ beta[:-1].astype(np.float32) + beta[-1], y[check], class_weights(y[check], total))
    return RuleModel(beta, a, b, threshold)


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "quality double, kept boolean"
)


def judged(column: pa.Array, model: RuleModel | None) -> tuple[dict[str, np.ndarray], np.ndarray, pa.Array, np.ndarray]:
    """The counts, whether the counted rules fail, the probability (null without a model) and whether the text is kept."""
    texts = texts_of(column)
    words = texts.words()
    counts = rule_counts(texts, words)
    n, again = counts["n_words"], counts["n_repeat_words"]
    failed = (n < 20) | (100 * again > 30 * n)
    if model is None:
        return counts, failed, pa.nulls(len(n), pa.float64()), ~failed
    p = model.probability(ngram_features(texts, words)).astype(float)
    return counts, failed, pa.array(p), ~failed & (p >= model.threshold)


def keep_by_rules(docs: DataFrame, model: RuleModel | None) -> DataFrame:
    """The rows of `docs` that `apply_rules` keeps, with all their columns; no row is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(judged(part.column("text"), model)[-1]))

    return docs.mapInArrow(run, docs.schema)


def apply_rules(docs: DataFrame, model: RuleModel | None, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with the counts of the rules, `base_failed`, the calibrated `quality` and `kept`.

    A text fails the counted rules below 20 words, or if more than 30 % of its words lie in windows of 8 words that come
    twice. Any other is kept where the model's probability reaches its threshold. Null texts are empty (and fail); without a
    model `quality` is null and the counted rules decide. One row per row; other columns do not matter. The whole text
    is read, in slices of some rows; the model's few thousand numbers travel with the task.
    """
    given = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]) + ", " + SCHEMA

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, failed, quality, kept = judged(part.column("text"), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(v.astype(np.int64)) for v in counts.values()] + [pa.array(failed), quality, pa.array(kept)],
                    [*keep, *counts, "base_failed", "quality", "kept"],
                )

    return given.mapInArrow(score, schema)
