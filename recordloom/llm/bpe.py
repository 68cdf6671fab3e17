"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by concatenating pieces."""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.words import slices

#: Distinct words a worker remembers with their ids before it starts anew.
REMEMBERED = 700_000
#: Words up to so many bytes are folded together in matrices; longer ones each by a heap.
MATRIX_BYTES = 48
#: Cells of a matrix.
CELLS = 1 << 20
NONE = np.int32(2**31 - 1)

# Code points that the `regex` package takes for letters or numbers and that the rank files' own library, whose
# Unicode tables are older, does not. They split a text as marks do.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 "
    "10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 "
    "1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_LATER = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split()) + "]")


@dataclass
class Vocabulary:
    """Ranks of byte strings; `pairs` are the sorted keys (left id << 32 | right id) of the merges, `merged` their ranks."""

    pattern: str
    pieces: list[bytes]
    byte_ids: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray
    ranks: dict[bytes, int] = field(repr=False)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file: base64 of the bytes and the rank in each line. Every single byte must have a rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        keys, merged = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        return cls(
            pattern, pieces, np.array([ranks[bytes([i])] for i in range(256)], np.int32),
            np.array(keys, np.int64)[order], np.array(merged, np.int32)[order], ranks,
        )

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of two ids, NONE where there is none (ids below 0 never merge)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of like length: in each round every word makes its leftmost merge of least rank."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        done = np.zeros((n, width), np.int32)
        while len(live):
            at = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, at]
            more = best != NONE
            if not more.all():
                done[live[~more]] = ids[~more][:, :width]
                live, ids, rank, at, best = live[more], ids[more], rank[more], at[more], best[more]
                row = row[: len(live)]
                if not len(live):
                    break
            shift = np.arange(ids.shape[1]) + (np.arange(ids.shape[1]) > at[:, None])
            ids[row, at] = best
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), shift, 1)
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 2)), constant_values=NONE), shift[:, :-1], 1)
            size[live] -= 1
            rank[row, at] = self.rank_of(ids[row, at], ids[row, at + 1])
            before = np.maximum(at - 1, 0)
            rank[row, before] = np.where(at > 0, self.rank_of(ids[row, before], ids[row, at]), rank[row, before])
        return [done[i, : size[i]] for i in range(n)]

    def fold_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word by a heap of merges, in time n log n."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.rank_of(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        pieces, ranks = self.pieces, self.ranks
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    made = ranks.get(pieces[ids[left]] + pieces[ids[right]])
                    if made is not None:
                        heapq.heappush(heap, (made, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids as little-endian unsigned 32-bit integers."""
        rest = []
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                yield word, whole.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                yield word, self.fold_long(raw).astype("<u4").tobytes()
            else:
                rest.append((len(raw), raw, word))
        rest.sort(key=lambda x: x[0])
        at = 0
        while at < len(rest):
            part = rest[at : at + max(1, CELLS // (rest[min(at + 4096, len(rest) - 1)][0] + 1))]
            part = [x for x in part if x[0] <= part[0][0] + 2]
            for (_, _, word), ids in zip(part, self.fold([x[1] for x in part]), strict=True):
                yield word, ids.astype("<u4").tobytes()
            at += len(part)


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Place and pattern of a public rank file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


#: What this worker knows: ids of words, by the vocabulary they belong to.
_KNOWN: dict[str, dict[str, bytes]] = {}


class Encoder:
    """Ids of whole texts; each distinct word is folded once while the worker remembers it."""

    def __init__(self, vocabulary: Vocabulary, key: str) -> None:
        self.vocabulary, self.known = vocabulary, _KNOWN.setdefault(key, {})
        self.found = _splitter(vocabulary.pattern).findall

    def split(self, text: str) -> list[str]:
        if text.isascii() or not _LATER.search(text):
            return self.found(text)
        # A private code point stands for each of them; the pieces are cut from the text itself.
        out, at = [], 0
        for piece in self.found(_LATER.sub("\ue000", text)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        words = [self.split(t) for t in texts]
        new = set().union(*words).difference(known) if words else set()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*words)
        known.update(self.vocabulary.encode_words(sorted(new)))
        return [b"".join(map(known.__getitem__, w)) for w in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with `ids` (binary, little-endian unsigned 32-bit) and `decoded` (binary).

    Special tokens do not exist: their strings are ordinary text. Null texts are empty and have no ids. One row per row;
    other columns do not matter. The vocabulary, of the size of its file, is the one thing that is broadcast.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path, pattern))
    given = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["ids binary", "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, f"{path} {pattern}")
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(pc.fill_null(part.column("text"), "").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.binary())],
                    [*keep, "ids", "decoded"],
                )

    return given.mapInArrow(run, schema)


def digests(encoded: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""
    return encoded.select(
        *keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def fold_in_sql(words: DataFrame, path: str, pattern: str, word: str = "word", buckets: int = 4096) -> DataFrame:
    """`words` with `ids` (array<int>), folded by higher-order functions alone over a literal rank map.

    A Spark map is searched entry by entry, so the literal is an array of small maps by a hash of the bytes. Exact, but every
    merge rebuilds arrays of an interpreted expression: see the README for its time. `encode_documents` is the
    operator; this form serves small lists of words.
    """
    spark: SparkSession = words.sparkSession
    vocabulary = Vocabulary.read(path, pattern)
    ranks = spark.createDataFrame([(k.hex().upper(), v) for k, v in vocabulary.ranks.items()], "piece string, rank int")
    spot = F.pmod(F.hash("piece"), F.lit(buckets))
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for r in ranks.select("piece", "rank", spot.alias("at")).collect():
        table[r["at"]][r["piece"]] = r["rank"]
    literal = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.get(literal, F.pmod(F.hash(piece), F.lit(buckets))), piece)

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(pieces) - 2),
            lambda i: F.struct(rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))).alias("rank"), i.alias("at")),
        )
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))
        joined = F.concat(
            F.slice(pieces, F.lit(1), best["at"]),
            F.array(F.concat(F.get(pieces, best["at"]), F.get(pieces, best["at"] + 1))),
            F.slice(pieces, best["at"] + 3, F.size(pieces)),
        )
        return F.when((F.size(pieces) < 2) | best.isNull(), pieces).otherwise(joined)

    text = F.hex(F.encode(F.col(word), "UTF-8"))
    size = F.length(text) / 2
    letters = F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: F.substring(text, i * 2 - 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), size.cast("int")), letters, step)
    whole = rank(text)
    return words.withColumn("ids", F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank)))
