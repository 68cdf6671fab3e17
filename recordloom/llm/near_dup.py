"""Near-duplicate documents by SetSketch registers: banding, joint likelihood, exact verification, connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import mix, slices, texts_of
from recordloom.session import cut_lineage

#: Registers; bands of ROWS registers each. At similarity 0.8 a pair misses all bands with probability 5e-8.
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: Base and rate of the registers, and their largest value.
BASE, RATE, TOP = 1.002, 20.0, 65535
#: A pair goes to verification unless its likelihood at the threshold is this much (natural log) below its best: 5 sigma.
SLACK = 12.5
#: Bits of the filter for the texts that are read a second time: a fixed 2 MB, whatever the input.
FILTER_BITS = 1 << 24
#: Links that one task closes; while there are more, rounds of contraction go on.
SMALL = 200_000
#: Nodes of a bucket whose pairs are written out; the pairs of larger buckets stay inside the tasks that compare them.
FEW = 32
#: Documents of a block when stragglers of larger buckets are compared.
BLOCK = 1024

_rng = np.random.Generator(np.random.PCG64(7))
_FLIP = _rng.integers(0, 2**64, REGISTERS, dtype=np.uint64)
_FACTOR = _rng.integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(part: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's runs of k words (A-Z in lower case); with fewer words, of all its words."""
    words = texts_of(part.column("text")).lower().words()
    n = words.counts()
    first, value = words.windows(k)
    row = words.row[first]
    begin = np.concatenate([[0], np.cumsum(n)])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = []
        for i in short:
            own = words.hash[begin[i] : begin[i + 1]].tolist()
            h = len(own)
            for x in own:
                h = (h * 0xD1342543DE82EF95 + x) % 2**64
            whole.append(h)
        row = np.concatenate([row, short])
        value = np.concatenate([value, mix(np.array(whole, np.uint64))])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return np.split(value, np.searchsorted(row, np.arange(1, part.num_rows)))


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row per set (empty: zeros): floor(1 - log_BASE of the least of its elements' exponentials).

    The maximum of the registers of two sets is the register of their union.
    """
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    elements = np.concatenate([sets[i] for i in full])
    first = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    least = np.empty((len(full), REGISTERS))
    for j in range(REGISTERS):
        least[:, j] = np.minimum.reduceat((elements ^ _FLIP[j]) * _FACTOR[j], first)
    spaced = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(spaced) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether similarity >= threshold is still likely for pairs of register rows, given the sets' sizes.

    The counts of larger, smaller and equal registers have a joint likelihood that depends on the similarity alone.
    """
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - up - down
    grid = np.concatenate([np.linspace(0.02, 0.98, 49) * threshold, np.linspace(threshold, 1, 12)])
    share = (na / (na + nb))[..., None]
    most = np.minimum(na, nb) / np.maximum(na, nb)

    def prob(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = prob(share * (1 + grid) - grid), prob((1 - share) * (1 + grid) - grid)
    log = up[..., None] * np.log(p) + down[..., None] * np.log(q) + same[..., None] * np.log(np.clip(1 - p - q, 1e-9, 1))
    at = len(grid) - 12
    return (most >= threshold - 1e-12) & (log[..., at:].max(-1) >= log.max(-1) - SLACK)


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits of each set, from two order-free sums."""
    out = []
    for s in sets:
        a = np.add.reduce(s, dtype=np.uint64) if len(s) else np.uint64(0)
        b = np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64) if len(s) else np.uint64(0)
        out.append(np.array([a, b], np.uint64).tobytes())
    return out


def row_key() -> Column:
    """A hash of id and text: rows that share it, and the id, are one."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """`(doc_id, key, n, digest, registers)`, one row per row of `docs`; `key` is a hash of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_digests(sets), pa.binary()),
                        pa.array([r.tobytes() for r in registers_of(sets)], pa.binary()),
                    ],
                    ["doc_id", "key", "n", "digest", "registers"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", row_key().alias("key"), "text")
    return given.mapInArrow(run, f"doc_id {kind}, key long, n long, digest binary, registers binary")


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """`(node, n, elements)` for nodes(node, of, digest): the texts of those rows only, known by `row_key`, read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part, shingle)
                hit = [i for i, (d, want) in enumerate(zip(_digests(sets), part.column("digest").to_pylist(), strict=True)) if d == want]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").take(pa.array(hit, pa.int64())),
                        pa.array([len(sets[i]) for i in hit], pa.int64()),
                        pa.array([sets[i].tobytes() for i in hit], pa.binary()),
                    ],
                    ["node", "n", "elements"],
                )

    spot = row_key().bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = nodes.select(F.col("of").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("spot")).groupBy(F.expr("spot >> 6").alias("word"))
    on = bits.agg(F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[on["word"].to_numpy(np.int64)] = on["bits"].to_numpy(np.int64).view(np.uint64)
    table = docs.sparkSession.sparkContext.broadcast(table)

    def likely_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_spot").to_numpy().astype(np.int64)
            hit = table.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.select(["_of", "text"]).filter(pa.array(hit.astype(bool)))

    # A filter of fixed size spares most texts the shuffle; the join decides.
    texts = docs.select(row_key().alias("_of"), "text", spot.alias("_spot")).mapInArrow(likely_in, "_of long, text string")
    found = texts.join(nodes, F.expr("_of = of")).select("node", "digest", "text")
    sets = found.mapInArrow(run, "node long, n long, elements binary")
    # A row that is repeated gives its set as often; one is enough.
    return sets.dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("a", "b"))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("node").alias("u"), F.col("elements").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("elements").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("a", "b"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            yield batch.select(["u", "v"]).filter(pa.array(likely(a, b, na, nb, percent / 100)))

    left = nodes.select(F.col("node").alias("u"), F.col("registers").alias("a"), F.col("n").alias("na"))
    right = nodes.select(F.col("node").alias("v"), F.col("registers").alias("b"), F.col("n").alias("nb"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "na", "b", "nb").mapInArrow(run, "u long, v long")


def _block_links(percent: int):
    """Links between the rows of two blocks of a bucket whose classes differ; only links leave the task, never its pairs.

    A pair that shares several buckets is compared in that of its first common band.
    """

    def unpack(frame: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        regs = np.frombuffer(b"".join(frame["registers"]), np.uint16).reshape(-1, REGISTERS)
        return regs, [np.frombuffer(x, np.uint64) for x in frame["elements"]]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        if left.empty or right.empty:
            return none
        (ra, sa), (rb, sb) = unpack(left), unpack(right)
        na, nb = left["n"].to_numpy(float), right["n"].to_numpy(float)
        band = left["band"].iloc[0]
        us, vs = [], []
        for i in range(len(sa)):
            test = (left["root"].iloc[i] != right["root"].to_numpy()) & (np.minimum(na[i], nb) * 100 >= percent * np.maximum(na[i], nb))
            at = np.flatnonzero(test)
            shared = (ra[i] == rb[at]).reshape(-1, BANDS, ROWS).all(-1)
            at = at[shared.argmax(-1) == band]
            if len(at):
                at = at[likely(ra[i][None], rb[at], np.full(len(at), na[i]), nb[at], percent / 100)]
            if not len(at):
                continue
            # One pass over all partners' elements at once.
            joined = np.concatenate([sb[j] for j in at])
            place = np.searchsorted(sa[i], joined)
            hit = sa[i][np.minimum(place, len(sa[i]) - 1)] == joined
            first = np.cumsum([0] + [len(sb[j]) for j in at[:-1]])
            both = np.add.reduceat(hit.astype(np.int64), first)
            union = na[i] + nb[at] - both
            for j in at[100 * both >= percent * union]:
                us.append(left["node"].iloc[i])
                vs.append(right["node"].iloc[j])
        return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)}) if us else none

    return lambda key, left, right: run(left.rename(columns=lambda c: c.removeprefix("lone_")), right)


def _closed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every node of a few links with the smallest node that it reaches."""
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            over.setdefault(u, u)
            over.setdefault(v, v)
            a, b = top(u), top(v)
            over[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": np.array(list(over), np.int64), "root": np.array([top(x) for x in over], np.int64)})


def classes_of(edges: DataFrame) -> DataFrame:
    """`(id, root)` for every node of `edges(u, v)`: nodes that links connect have one root, which is one of them.

    Each round every node joins its neighbour of lowest rank (or stays), and the graph shrinks to the nodes joined to. Ranks are ids at
    first, which closes stars around a smallest node at once, then a new hash in every round, so that of any chain a
    share goes in each: the rounds grow with the logarithm of the longest. Minima are partial aggregates. Once no more than
    SMALL links (two numbers each) are left, one task closes them.
    """
    left = cut_lineage(edges.filter("u <> v").select("u", "v").distinct())
    steps: list[DataFrame] = []
    while left.count() > SMALL:
        rank = F.xxhash64("v", F.lit(len(steps))) if steps else F.col("v")
        own = F.xxhash64("u", F.lit(len(steps))) if steps else F.col("u")
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(F.struct(rank.alias("rank"), F.col("v").alias("v"))).alias("m"))
        joined = cut_lineage(
            lowest.select(F.col("u").alias("id"), F.when(F.col("m.rank") < own, F.col("m.v")).otherwise(F.col("u")).alias("root"))
        )
        steps.append(joined)
        to_u, to_v = joined.toDF("u", "ru"), joined.toDF("v", "rv")
        left = cut_lineage(left.join(to_u, "u").join(to_v, "v").filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    steps.append(cut_lineage(left.coalesce(1).mapInPandas(_closed, "id long, root long")))
    roots = steps[0]
    for step in steps[1:]:
        further = step.toDF("root", "next")
        roots = roots.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)`, one row per row of `docs`.

    Documents are linked where 100 * intersection >= percent * union of their sets of word shingles; a class holds all that links
    reach, and is named by its smallest doc_id (null only if all its ids are null). `kept` is true for that document. Null and
    empty texts have an empty set and are linked with nothing. Rows that repeat a doc_id share its class only if their texts
    are linked; if that id is the smallest, all its rows are kept.

    1. Equal sets meet by a 128-bit digest: one node for each distinct set.
    2. Every node goes to BANDS buckets of ROWS registers. In each bucket all nodes are paired with the smallest one only.
       Pairs pass the joint likelihood of their registers, then a check on the full sets.
    3. In buckets whose other nodes still belong to several classes, each straggler (a node outside the largest class) is compared
       with all of them, again by likelihood and then exactly: pair by pair in buckets of up to FEW nodes, block by block in
       larger ones, whose pairs are not written. So every link between texts that share a bucket counts, and texts that share
       none are never compared, however far chains of buckets reach.

    Every step is keyed by node or by block, so a bucket or class of any size is spread; only the texts of nodes in shared
    buckets are read a second time.
    """
    return _classed(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def _classed(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """`(doc_id, key, n_shingles, component_id, stays)`, one row per row of `docs`; rows that stay share doc_id and key, or have no words."""
    rows = cut_lineage(sketches(docs, shingle).withColumn("row", F.monotonically_increasing_id()))
    some = rows.filter("n > 0")
    nodes = some.groupBy("digest").agg(
        F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"), F.min_by("key", "row").alias("of"),
        F.first("registers").alias("registers"), F.first("n").alias("n"),
    )
    nodes = cut_lineage(nodes)
    width = 2 * ROWS
    bands = nodes.select("node", F.posexplode(F.array(*[F.xxhash64(F.expr(f"substring(registers, {1 + width * b}, {width})"), F.lit(b)) for b in range(BANDS)]))).select(
        "node", F.col("pos").alias("band"), F.col("col").alias("bucket")
    )
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).filter("size > 1").select("bucket", "hub")
    members = cut_lineage(bands.join(shared, "bucket"))
    pairs = members.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    inside = members.select("node").distinct()
    busy = cut_lineage(nodes.join(inside, "node", "left_semi"))
    sets = cut_lineage(full_sets(docs, busy.select("node", "of", "digest"), shingle))
    links = cut_lineage(verified(_likely_pairs(pairs, busy, percent), sets, percent))

    roots = classes_of(links)
    placed = busy.select("node").join(roots.withColumnRenamed("id", "node"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
    found = cut_lineage(_straggler_links(members.join(placed, "node"), busy, sets, percent))
    roots = classes_of(links.unionByName(found)).withColumnRenamed("id", "node")

    labelled = nodes.select("node", "digest", "best").join(roots, "node", "left").select(
        "digest", "best", F.coalesce("root", "node").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("best").alias("first"))
    classes = labelled.join(least, "root").select("digest", F.col("first.doc_id").alias("component"), F.col("first.key").alias("first"))
    own = rows.filter("n = 0").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")
    )
    rest = some.select("doc_id", "key", "n", "digest").join(classes, "digest").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.expr("doc_id <=> component AND key = first").alias("stays"),
    )
    return rest.unionByName(own)


def _straggler_links(rooted: DataFrame, busy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links from nodes outside their bucket's largest class to its other nodes, for `rooted(bucket, band, hub, node, root)`.

    All nodes of a bucket have been compared with its hub, so that is left out, and with it most buckets that two nodes share by chance.
    """
    rest = rooted.filter("node <> hub")
    classes = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    shape = classes.groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"))
    known = cut_lineage(rest.join(shape.filter("most < all"), "bucket").drop("hub"))

    few = known.filter(F.col("all") <= FEW)
    left, right = few.select("bucket", F.col("node").alias("u"), F.col("root").alias("ru")), few.select("bucket", F.col("node").alias("v"), F.col("root").alias("rv"))
    pairs = left.join(right, "bucket").filter("u < v AND ru <> rv").select("u", "v").distinct()
    links = verified(_likely_pairs(pairs, busy, percent), sets, percent)

    many = known.filter(F.col("all") > FEW)
    whole = cut_lineage(many.join(busy.select("node", "n", "registers"), "node").join(sets.select("node", "elements"), "node"))
    blocks = F.ceil(F.col("all") / BLOCK).cast("long")
    lone_blocks = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("long")
    spot = F.xxhash64("node")
    columns = ["bucket", "a", "b", "band", "node", "root", "n", "registers", "elements"]
    every = whole.withColumn("b", F.pmod(spot, blocks)).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), lone_blocks - 1)))
    lone = whole.filter("root <> main").withColumn("a", F.pmod(spot, lone_blocks)).withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    keys = ["bucket", "a", "b"]
    by_lone = lone.select(*columns).toDF(*[f"lone_{c}" for c in columns]).groupBy(*[f"lone_{k}" for k in keys])
    return links.unionByName(by_lone.cogroup(every.select(*columns).groupBy(*keys)).applyInPandas(_block_links(percent), "u long, v long"))


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one stays for each class: that of the smallest doc_id, null last.

    Documents without words stay, every one. Rows are told apart by doc_id and text, so different texts under one id, or under none,
    are judged each by its own class; of equal rows with words one stays. Rows are joined to those that go, or repeat, so all
    other rows only pass.
    """
    found = _classed(docs, shingle, percent)
    ids = found.groupBy(F.col("doc_id").alias("_keep"), F.col("key").alias("_of")).agg(
        F.max("stays").alias("_stays"), F.sum((F.col("n_shingles") > 0).cast("int")).alias("_rows")
    )
    ids = cut_lineage(ids.filter("NOT _stays OR _rows > 1"))
    mark = docs.withColumn("_key", row_key()).join(ids, F.expr("doc_id <=> _keep AND _key = _of"), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = mark.filter("_rows IS NULL").select(*columns)
    # Only rows that repeat are grouped.
    again = mark.filter("_stays AND _rows > 1").dropDuplicates(["doc_id", "_key"]).select(*columns)
    return once.unionByName(again)
