"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.prefix import running_sum
from recordloom.session import cut_lineage

#: A run of bytes between white space.
WORD = r"[^\x20\x09-\x0D]+"


def fair_targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Shares of `budget` by weight, none above `most` times its size; what a full source leaves is shared again.

    The answer is min(most * size, weight * T) for the one level T at which the shares add up to the budget, or most * size
    for all if the budget is above that.
    """
    limit = [most * s for s in sizes]
    left, weight, level = float(budget), float(sum(weights)), float("inf")
    for i in sorted(range(len(sizes)), key=lambda i: limit[i] / weights[i]):
        if limit[i] / weights[i] * weight > left:
            level = left / weight
            break
        left -= limit[i]
        weight -= weights[i]
    return [min(m, w * level) for m, w in zip(limit, weights, strict=True)]


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document: the columns of `docs`' numbers with `takes` (0 to `repeats`).

    Returns `_row` columns doc_id, source, text_hash, size, source_size, target, takes, taken; one row per input row.

    Sources in the order of their code points, null last, have the weights in turn. Documents of a source are shuffled
    by a hash; copy e of a document has the virtual finish time (words of the source up to and including it + e *
    words of the source) / weight. All copies are range-sorted by finish time and the queue is cut where the total budget
    (`share` of all words) is spent. A source that has run out drops from the queue, which shares its part
    among the others by weight.

    A size is the number of words of the whole text (null text: 0). Documents without words are never taken. Ties are ordered by
    doc_id (null first), then text hash; equal rows are interchangeable. An empty table gives an empty result. Only
    numbers are shuffled. The sources, one row each, meet in the driver: they are the entries of a weight table.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = cut_lineage(rows)
    per = sorted(
        ((r["source"], r["n"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()),
        key=lambda x: (x[0] is None, (x[0] or "").encode()),
    )
    w = [float(weights[i % len(weights)]) for i in range(len(per))]
    budget = share * sum(n for _, n in per)
    targets = fair_targets([n for _, n in per], w, budget, float(repeats))
    sources = spark.createDataFrame(
        [(s, n, x, t) for (s, n), x, t in zip(per, w, targets, strict=True)],
        "source string, source_size long, weight double, target double",
    )
    known = rows.alias("r").join(F.broadcast(sources).alias("s"), F.expr("r.source <=> s.source")).select(
        "r.*", "s.source_size", "s.weight", "s.target", F.xxhash64("doc_id", "text_hash", F.lit(seed)).alias("_shuffle")
    )
    queued = running_sum(known, ["_shuffle", "doc_id", "text_hash"], "size", "_words", group="source")
    copies = (
        queued.filter("size > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .select(
            "doc_id", "source", "text_hash", "size", "_shuffle", "copy",
            ((F.col("_words") + F.col("copy") * F.col("source_size")) / F.col("weight")).alias("finish"),
        )
    )
    order = ["finish", "_shuffle", "doc_id", "text_hash", "copy"]
    spent = running_sum(copies, order, "size", "_spent")
    takes = (
        spent.filter(F.col("_spent") <= budget)
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Equal rows share their copies: the first of them take one more where the count does not divide.
    same = rows.groupBy("doc_id", "source", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"))
    joined = same.alias("a").join(
        takes.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.source <=> b.source AND a.text_hash <=> b.text_hash"), "left"
    )
    split = joined.select(
        "a.*", F.coalesce("b.n", F.lit(0)).alias("n")
    ).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return (
        split.alias("d")
        .join(F.broadcast(sources).alias("s"), F.expr("d.source <=> s.source"))
        .select(
            "d.doc_id", "d.source", "d.text_hash", "d.size", "s.source_size", "s.target",
            (F.floor(F.col("n") / F.col("rows")) + (F.col("_i") <= F.col("n") % F.col("rows")).cast("long")).cast("long").alias("takes"),
        )
        .withColumn("taken", F.col("takes") * F.col("size"))
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it is taken, with all their columns.

    The decisions are joined back by doc_id, source and text hash; equal rows are told apart by their number.
    """
    takes = (
        mix_sources(docs, **settings)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"))
        .agg(F.sum("takes").alias("_takes"), F.count(F.lit(1)).alias("_rows"))
        .filter("_takes > 0")
    )
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    joined = keyed.join(takes, F.expr("doc_id <=> _doc AND source <=> _source AND _h = _hash"))
    # All equal rows carry the same columns that matter here, so takes are dealt evenly over them by a row number.
    once = joined.filter("_rows = 1").withColumn("_n", F.col("_takes"))
    return once.unionByName(_dealt(joined.filter("_rows > 1"))).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))
    ).select(*[F.col(f"`{c}`") for c in docs.columns])


def _dealt(rows: DataFrame) -> DataFrame:
    """Deal `_takes` over rows that repeat: each gets the whole part, the first ones in a running count the rest."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("_doc", "_source", "_hash").orderBy("_h"))
    return (
        rows.withColumn("_i", number)
        .withColumn("_n", F.floor(F.col("_takes") / F.col("_rows")) + (F.col("_i") <= F.col("_takes") % F.col("_rows")).cast("long"))
        .filter("_n > 0")
        .drop("_i")
    )
