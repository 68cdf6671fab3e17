"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other, then score together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.linear import fit_platt, sigmoid
from recordloom.llm.rules import repeated
from recordloom.llm.words import SEPARATOR, slices, texts_of
from recordloom.session import cut_lineage

#: Hashed shape trigrams of the text view; hashed cells of language and of source in the metadata view.
SHAPES, LANGS, SOURCES = 40, 8, 24
#: A view's label for an unlabelled document counts from this probability on.
CONFIDENT = 0.98
#: Rounds of exchange, Newton steps of each fit, and the ridge.
ROUNDS, STEPS, RIDGE = 2, 5, 1e-3
#: Weight of all pseudo-labels of a class against all given labels of a class.
PSEUDO = 0.5
#: Bytes whose trigrams are hashed at once.
SEGMENT = 1 << 19
#: Bins of a score, for calibration.
BINS = 64

#: Letters, capitals, digits and white space are one shape each; other ASCII marks are their own.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[128:], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[SEPARATOR] = 97, 97, 65, 48, 32


def text_view(part: pa.RecordBatch) -> np.ndarray:
    """Features of the whole text: shares of marks, capitals and digits, repetition, lengths, and hashed shape trigrams."""
    texts = texts_of(part.column("text"))
    words = texts.words()
    n, size = len(texts), np.diff(texts.offsets).astype(float)
    count = words.counts().astype(float)
    length = (words.ends - words.starts).astype(float)
    per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
    shape = _SHAPE[texts.data]

    def share(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit)])
        return (total[texts.offsets[1:]] - total[texts.offsets[:-1]]) / per_byte

    mark = (shape != 97) & (shape != 65) & (shape != 48) & (shape != 32)
    _, again = repeated(words.row, words.hash)
    after = np.zeros(len(words.hash), bool)
    if len(after) > 1:
        after[1:] = (words.row[1:] == words.row[:-1]) & (words.hash[1:] == words.hash[:-1])
    mean = np.bincount(words.row, length, n) / per_word
    short = np.bincount(words.row, length <= 3, n) / per_word
    dense = np.stack([
        share(mark), share(shape == 65), share(shape == 48), share(texts.data == 0x0A) * 10, share(texts.data >= 128),
        np.bincount(words.row, again, n) / per_word, np.bincount(words.row, after, n) / per_word, mean / 10, short,
        np.log1p(count) / 5, (count < 20).astype(float),
    ], 1)
    cells = np.zeros((n, SHAPES))
    for at in range(0, len(shape) - 2, SEGMENT):
        code = shape[at : at + SEGMENT + 2].astype(np.int64)
        gram = (code[:-2] * 65537 + code[1:-1] * 257 + code[2:]) * 2654435761 % (1 << 32) * SHAPES >> 32
        # A trigram counts for the row of its first byte, if it ends in the same row.
        lo, hi = (np.clip(v, at, at + len(gram)) - at for v in (texts.offsets[:-1], np.maximum(texts.offsets[1:] - 2, texts.offsets[:-1])))
        edge = np.bincount(lo, minlength=len(gram) + 1) - np.bincount(hi, minlength=len(gram) + 1)
        key = np.repeat(np.arange(n), hi - lo) * SHAPES + gram[np.cumsum(edge)[:-1] > 0]
        cells += np.bincount(key, minlength=n * SHAPES).reshape(n, SHAPES)
    cells /= per_byte[:, None]
    return np.concatenate([dense, np.sqrt(cells)], 1).astype(np.float32)


TEXT_DIM = 11 + SHAPES
META_DIM = LANGS + SOURCES + 3


def _meta() -> dict[str, Column]:
    """What the metadata view reads: hashes of lang and source, and n_chars."""

    def hashed(name: str) -> Column:
        return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\0"))).bitwiseAND(F.lit(2**62 - 1))

    return {"lang_hash": hashed("lang"), "source_hash": hashed("source"), "chars": F.col("n_chars").cast("double")}


def meta_view(part: pa.RecordBatch) -> np.ndarray:
    """Features of lang, source and n_chars (nulls are values of their own); the text is not looked at."""
    n = part.num_rows
    out = np.zeros((n, META_DIM), np.float32)
    lang, source = (part.column(c).to_numpy(zero_copy_only=False).astype(np.uint64) for c in ("lang_hash", "source_hash"))
    out[np.arange(n), (lang % np.uint64(LANGS)).astype(int)] = 1
    out[np.arange(n), LANGS + (source % np.uint64(SOURCES)).astype(int)] = 1
    chars = part.column("chars").to_numpy(zero_copy_only=False).astype(float)
    known = np.isfinite(chars) & (chars >= 0)
    size = np.log1p(np.where(known, chars, 0)) / 10
    out[:, -3], out[:, -2], out[:, -1] = np.where(known, size, 0), np.where(known, size * size, 0), ~known
    return out


VIEWS = (("text_view", TEXT_DIM), ("meta_view", META_DIM))


def _views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, _key, y, fold, text_view, meta_view)`: the views as float32 bytes; y is null without one agreed label."""
    agreed = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_lo"), F.max("quality").alias("_hi"))
        .filter("_lo = _hi")
        .select(F.col("doc_id").alias("_id"), F.col("_lo").cast("double").alias("y"))
    )

    given = docs.select("doc_id", "text", *[c.alias(n) for n, c in _meta().items()], F.xxhash64("doc_id", "text").alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                views = [[r.tobytes() for r in view(part)] for view in (text_view, meta_view)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_key"), *[pa.array(v, pa.binary()) for v in views]], ["doc_id", "_key", "text_view", "meta_view"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = given.mapInArrow(run, f"doc_id {kind}, _key long, text_view binary, meta_view binary")
    # Labels come to the small rows of features, not to the texts.
    return made.join(agreed, F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(float)


def _decision(x: np.ndarray, model: dict) -> np.ndarray:
    return ((x - model["mean"]) / model["scale"]) @ model["beta"][:-1] + model["beta"][-1]


def _probability(x: np.ndarray, model: dict) -> np.ndarray:
    return sigmoid(model["a"] * _decision(x, model) + model["b"])


def _summed(rows: DataFrame, emit) -> dict[str, np.ndarray]:
    """Sums over all rows of the vectors that `emit` makes of a batch, added by name and place: each task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for name, value in emit(batch).items():
                    sums[name] = sums.get(name, 0) + value
        for name, value in sums.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"name": name, "i": np.arange(len(value), dtype=np.int32), "value": np.asarray(value, float)}), preserve_index=False)

    found = rows.mapInArrow(run, "name string, i int, value double").groupBy("name", "i").agg(F.sum("value").alias("value")).toPandas()
    return {name: part.sort_values("i")["value"].to_numpy() for name, part in found.groupby("name")}


def _targets(batch: pa.RecordBatch, models: dict | None, learner: str) -> tuple[np.ndarray, np.ndarray]:
    """(y, weight) of each row for one view: its given label, or the other view's confident one with a lower weight."""
    y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
    # A fifth of the labels is held back to calibrate.
    held = batch.column("fold").to_numpy(zero_copy_only=False) == 0
    given = ~np.isnan(y) & ~held
    weight = given.astype(float)
    if models:
        (teacher, dim), = [v for v in VIEWS if v[0] != learner]
        p = _probability(_matrix(batch.column(teacher), dim), models[teacher])
        sure = np.isnan(y) & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
        y, weight = np.where(sure, p >= 0.5, y), np.where(sure, -1.0, weight)
    return np.where(np.isnan(y), 0, y), weight


def _fit_views(rows: DataFrame, models: dict | None) -> dict | None:
    """Both views' models, from all labelled rows and, once there are models, from all rows the other view is sure of.

    Newton steps: each is one pass over the rows for both views, whose gradients and curvatures are summed by Spark.
    """

    def shape(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for name, dim in VIEWS:
            x = _matrix(batch.column(name), dim)
            y, w = _targets(batch, models, name)
            four = [((w == s) & (y == c)).sum() for s in (1, -1) for c in (0, 1)]
            out[name] = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0), four])
        return out

    first = _summed(rows, shape)
    if not first:
        return None
    made, scale = {}, {}
    for name, dim in VIEWS:
        s = first[name]
        n, four = s[0], s[-4:]
        if not four[0] or not four[1]:
            return None
        mean = s[1 : dim + 1] / n
        spread = np.sqrt(np.maximum(s[dim + 1 : 2 * dim + 1] / n - mean * mean, 0))
        made[name] = {"mean": mean, "scale": np.where(spread > 1e-6, spread, 1), "beta": np.zeros(dim + 1), "a": 1.0, "b": 0.0}
        # The classes weigh the same, and so do their pseudo-labels.
        scale[name] = {s_: [(0.5 if s_ == 1 else 0.5 * PSEUDO) / max(four[(0 if s_ == 1 else 2) + c], 1) for c in (0, 1)] for s_ in (1, -1)}
    for _ in range(STEPS):

        def curve(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = {}
            for name, dim in VIEWS:
                y, w = _targets(batch, models, name)
                on = w != 0
                if not on.any():
                    continue
                m = made[name]
                x = np.column_stack([(_matrix(batch.column(name), dim)[on] - m["mean"]) / m["scale"], np.ones(on.sum())])
                y, w = y[on], w[on]
                weight = np.where(w > 0, np.where(y > 0, scale[name][1][1], scale[name][1][0]), np.where(y > 0, scale[name][-1][1], scale[name][-1][0]))
                p = sigmoid(x @ m["beta"])
                h = weight * np.maximum(p * (1 - p), 1e-6)
                out[name] = np.concatenate([x.T @ (weight * (p - y)), (x.T @ (x * h[:, None])).ravel()])
            return out

        sums = _summed(rows, curve)
        for name, dim in VIEWS:
            m, s = made[name], sums[name]
            ridge = np.append(np.full(dim, RIDGE), 1e-9)
            step = np.linalg.solve(s[dim + 1 :].reshape(dim + 1, dim + 1) + np.diag(ridge), s[: dim + 1] + ridge * m["beta"])
            m["beta"] = m["beta"] - step / max(1.0, float(np.abs(step).max()) / 4)
    return _calibrated(rows, made)


def _calibrated(rows: DataFrame, models: dict) -> dict:
    """Platt scaling of each view on the labels that no fit has seen, from counts by bin of the decision and label."""

    def bins(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        on = ~np.isnan(y) & (batch.column("fold").to_numpy(zero_copy_only=False) == 0)
        out = {}
        for name, dim in VIEWS:
            at = np.clip(((np.tanh(_decision(_matrix(batch.column(name), dim)[on], models[name]) / 8) + 1) / 2 * BINS).astype(int), 0, BINS - 1)
            out[name] = np.bincount(at * 2 + (y[on] > 0), minlength=2 * BINS).astype(float)
        return out

    middle = 8 * np.arctanh((np.arange(BINS) + 0.5) / BINS * 2 - 1)
    for name, count in _summed(rows, bins).items():
        z, y = np.repeat(middle, 2), np.tile([0.0, 1.0], BINS)
        if count.sum():
            models[name]["a"], models[name]["b"] = fit_platt(z, y, count)
            models[name]["prior"] = float((count[1::2].sum() + 1) / (count.sum() + 2))
    return models


def fit_cotrained(rows: DataFrame, rounds: int) -> dict | None:
    models = None
    for _ in range(rounds + 1):
        models = _fit_views(rows, models)
        if models is None:
            return None
    return models


def combined(views: list[np.ndarray], models: dict) -> list[np.ndarray]:
    """The calibrated probability of each view, and that of both."""
    p = [np.clip(_probability(x, models[name]), 1e-9, 1 - 1e-9) for x, (name, _) in zip(views, VIEWS, strict=True)]
    prior = models["text_view"].get("prior", 0.5)
    return [*p, sigmoid(sum(np.log(x / (1 - x)) for x in p) - np.log(prior / (1 - prior)))]


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `docs`, with all their columns, whose combined score reaches the threshold.

    The models are fitted as in `score_quality`; then the rows are scored where they are read, so no text is shuffled.
    """
    rows = cut_lineage(_views(docs, labels))
    models = fit_cotrained(rows, rounds)
    if models is None:
        return docs
    mark = "_" * (1 + max(map(len, docs.columns)))
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n.removeprefix(mark) for n in batch.schema.names]
            for part in slices(batch):
                own = pa.RecordBatch.from_arrays([part.column("text"), *part.columns[width:]], ["text", *names[width:]])
                score = combined([text_view(own), meta_view(own)], models)[-1]
                yield part.select(range(width)).filter(pa.array(score >= threshold))

    return docs.select("*", *[c.alias(mark + n) for n, c in _meta().items()]).mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """Per row of `docs`: doc_id, text_score, meta_score, score, kept, and _key (a hash of doc_id and text).

    Each view is fitted on the agreed labels; in each round it is fitted again with the labels of which the other view is sure
    (probability CONFIDENT) added for all unlabelled documents. Then the calibrated views are combined as independent evidence:
    log-odds added, the shared prior counted once; `kept` where the score reaches the threshold.

    Null and empty texts and null metadata are features like others. Labels that are null or disagree are not used; if a class
    is missing, scores are null and all rows kept. Rows may repeat. The texts are read once; the rounds work on rows of a few
    hundred bytes in the shared folder, cover all of them, and bring only sums to the driver.
    """
    rows = cut_lineage(_views(docs, labels))
    models = fit_cotrained(rows, rounds)
    if models is None:
        return rows.select(
            "doc_id", *[F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")], F.lit(True).alias("kept"), "_key"
        )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *p, score = combined([_matrix(batch.column(name), dim) for name, dim in VIEWS], models)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p[0]), pa.array(p[1]), pa.array(score), pa.array(score >= threshold), batch.column("_key")],
                ["doc_id", "text_score", "meta_score", "score", "kept", "_key"],
            )

    return rows.select("doc_id", "text_view", "meta_view", "_key").mapInArrow(
        run, f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean, _key long"
    )
