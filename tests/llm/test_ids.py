"""Ids that are texts, null or shared by unrelated rows."""

import random

from pyspark.sql import functions as F

from recordloom.llm import near_dup, rules


def test_rules_with_text_ids(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "river", "was", "calm", "and", "wide"]) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["win", "cash", "now", "click", "$$$"]) for _ in range(60)) for _ in range(60)]
    rows = [(f"d{i}", t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i < 60)) for i in range(120)], "doc_id string, quality int")
    model = rules.fit_rules(docs, labels)
    numbered = docs.withColumn("doc_id", F.expr("int(substring(doc_id, 2))"))
    same = rules.fit_rules(numbered, labels.withColumn("doc_id", F.expr("int(substring(doc_id, 2))")))
    assert model is not None and same is not None
    kept = {r.doc_id: r.kept for r in rules.apply_rules(docs, model, ["doc_id"]).collect()}
    assert len(kept) == 120 and all(not kept[f"d{i}"] for i in range(60, 120))


def test_many_rows_without_an_id(spark):
    """Rows without an id meet their own text only: as many joined rows as rows, and classes by text."""
    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(400)) for _ in range(40)) for _ in range(500)]
    rows = [(None, t) for t in texts] + [(None, t + " more") for t in texts] + [(i, t) for i, t in enumerate(texts[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = docs.select(near_dup.row_key().alias("of"), F.monotonically_increasing_id().alias("node"))
    assert keyed.alias("a").join(keyed.alias("b"), "of").count() == len(rows)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.component_id is not None for r in got) == 60
    kept = near_dup.keep_representatives(docs)
    assert kept.count() == 500 and kept.filter("doc_id IS NOT NULL").count() == 20
