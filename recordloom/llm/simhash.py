"""Near-duplicate documents by SimHash fingerprints: covering tables, an exact check of the bits, connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.near_dup import classes_of
from recordloom.llm.words import slices
from recordloom.session import cut_lineage

BITS = 64
#: Hashes whose bits are summed at once: 4 MB of bits, whatever the length of a text.
COUNTED = 1 << 16
#: Members of a bucket that are compared with each other; larger buckets meet at centres, see `_by_centres`.
MOST = 256


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit j is 1 if it is set in over half the XXH64 of the text's runs of words (A-Z in lower case), repeats included.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; a text of fewer words is one run, one without words gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    data, take = b" ".join(words), min(shingle, len(words))
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
    starts = np.concatenate([[0], gaps + 1])[: len(words) - take + 1]
    ends = np.concatenate([gaps, [len(data)]])[take - 1 :]
    half, ones = len(starts), np.zeros(BITS, np.int64)
    for at in range(0, len(starts), COUNTED):
        spans = zip(starts[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(data[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """`(doc_id, print)`, one row per row of `docs`: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary()).to_pylist()
                prints = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print long")


def covering_masks(radius: int, seed: int = 5) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bits all lie outside one of them.

    Each bit gets a nonzero vector of radius+1 bits, and the mask of a nonzero vector v holds the bits whose vectors have an odd
    product with v. The vectors of `radius` bits span at most `radius` dimensions, so some v is orthogonal to all of them: fingerprints that
    differ in these bits alone agree under its mask. All vectors are used equally often, so each mask holds somewhat over half the bits.
    """
    count = (1 << (radius + 1)) - 1
    vector = np.random.Generator(np.random.PCG64(seed)).permutation(BITS) % count + 1
    return [sum(1 << j for j in range(BITS) if int(vector[j] & v).bit_count() % 2) for v in range(1, count + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _in_bucket(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for members in batch.column("members"):
                own = np.sort(members.values.to_numpy(zero_copy_only=False))
                near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
                # Every member takes the smallest label of its neighbours until none changes: links to one of each class leave.
                label = np.arange(len(own))
                while (least := np.where(near, label[None, :], len(own)).min(1)).tolist() != label.tolist():
                    label = least
                moved = np.flatnonzero(label != np.arange(len(own)))
                us.append(own[label[moved]])
                vs.append(own[moved])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _by_centres(prints: DataFrame, radius: int) -> DataFrame:
    """Links among any number of fingerprints without comparing them: radius 2 or 1 only.

    Fingerprints at two bits or fewer share a centre, a value at one bit or fewer from both. So each is sent to its 65 centres, and all
    that meet at a centre are linked to each other, by the smallest. A centre has at most 65 members.
    """
    if radius == 1:
        # The fingerprint whose bit is zero is the centre.
        centres = F.array("print", *[F.expr(f"print & {_signed(~(1 << j) & (2**BITS - 1))}L") for j in range(BITS)])
        met = prints.select("print", F.explode(F.array_distinct(centres)).alias("centre")).groupBy("centre").agg(F.collect_set("print").alias("met"))
        # All that meet there are the centre itself and values one bit above it, which need the centre to be linked.
        met = met.filter("size(met) > 1 AND array_contains(met, centre)").select(F.col("centre").alias("u"), F.explode("met").alias("v"))
        return met.filter("u <> v")
    if radius != 2:
        raise ValueError("buckets beyond the bound need a radius of 1 or 2")
    centres = F.array("print", *[F.col("print").bitwiseXOR(F.lit(_signed(1 << j)).cast("long")) for j in range(BITS)])
    met = prints.select("print", F.explode(centres).alias("centre")).groupBy("centre").agg(F.collect_set("print").alias("met"))
    met = met.filter("size(met) > 1").select(F.array_min("met").alias("u"), F.explode("met").alias("v"))
    return met.filter("u <> v")


def near_links(prints: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """`(u, v)`: links that connect all of the distinct fingerprints `prints(print)` that differ in `radius` bits or fewer.

    Each goes to one bucket of every covering table. Buckets of up to `most` members are compared inside, and a link leaves for each member
    that is not the smallest of its class there. Members of larger buckets meet at centres instead, so no bucket is capped.
    """
    masks = [F.struct(F.lit(t).alias("t"), F.expr(f"print & {_signed(m)}L").alias("key")) for t, m in enumerate(covering_masks(radius))]
    placed = prints.select("print", F.inline(F.array(*masks)))
    sizes = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = cut_lineage(placed.join(sizes, ["t", "key"]))
    small = shared.filter(F.col("size") <= most).groupBy("t", "key").agg(F.collect_list("print").alias("members"))
    links = small.select("members").mapInArrow(_in_bucket(radius), "u long, v long")
    large = cut_lineage(shared.filter(F.col("size") > most).select("print").distinct())
    if not large.isEmpty():
        links = links.unionByName(_by_centres(large, radius))
    return cut_lineage(links.distinct())


def similar_documents(docs: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """`(doc_id, fingerprint, component_id)`, one row per row of `docs`; `fingerprint` is 16 hex digits.

    Documents link where their fingerprints differ in `radius` bits or fewer; a class holds all that links reach, and is named by its
    smallest doc_id (null only if all its ids are null). Null and empty texts have fingerprint zero and are linked like any other.
    Rows that repeat an id or a text are rows of their own. Copies meet by fingerprint before anything is compared, so a
    group of them is one node; tables, sizes, links and classes stay in Spark, keyed by bucket, centre or fingerprint.
    """
    rows = cut_lineage(fingerprints(docs))
    nodes = cut_lineage(rows.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")))
    roots = classes_of(near_links(nodes.select("print"), radius, most)).withColumnRenamed("id", "print")
    rooted = nodes.join(roots, "print", "left").select("print", "best", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("best").alias("first"))
    named = rooted.join(least, "root").select("print", F.col("first.doc_id").alias("component_id"))
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
