"""Language-model scoring by a probabilistic suffix tree over words.

The root of the tree is the smoothed distribution of all words of the training texts, counted exactly. Below it are contexts of one
word and more that are seen at least LEAST times; a context becomes a state if its next-word distribution diverges enough from
that of the longest state that is its suffix. A word's probability comes from the longest state that is a suffix of what
stands before it. Counts, states and probabilities are Spark tables by the hash of a run of words, whatever their number;
`Grams`, `grow` and `Tree` are the same model in one process, for small texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import SLICE_BYTES, SLICE_ROWS, mix, slices, texts_of
from recordloom.session import scratch

#: Least occurrences of a context or transition, at any size of the input.
LEAST = 4
#: The longest context.
DEPTH = 2
#: Taken off every count of a transition and given to the shorter context.
DISCOUNT = 0.75
#: Least divergence (nats per occurrence) of a state from its suffix.
DIVERGENCE = 0.01
#: Buckets of runs, at least, and bytes of text whose runs make one bucket.
BUCKETS, BUCKET_BYTES = 64, 64 << 20
#: The symbol that ends a text, and stands before its first word.
END = np.uint64(0x5A17E0F7E27C0DE5)
#: Bits of the filters that spare runs the shuffle for each of their keys, at least so long as all are not more than the last; a run that passes
#: for nothing is only a few bytes more. A filter is made in parts.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST, FILTER_PARTS = 16, 1 << 18, 1 << 29, 64
#: Runs that a task holds before it makes them distinct or hands them on.
HELD = 1 << 21
#: The most frequent words and runs, at most, whose values every task holds (28 bytes each); all others meet their values by bucket.
HOT = 1 << 19
#: Slices of text whose runs are handed on together for their scores, at most.
SLICES = 16


def in_training(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves another remainder by 7 than 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 != 2


def token_stream(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every token: the words (A-Z in lower case), then one END for each row."""
    words = texts_of(part.column("text")).lower().words()
    n = words.counts()
    ends = np.cumsum(n + 1) - 1
    row = np.repeat(np.arange(part.num_rows), n + 1)
    token = np.full(len(row), END, np.uint64)
    inner = np.ones(len(row), bool)
    inner[ends] = False
    token[inner] = words.hash
    return row, token


def _shifted(row: np.ndarray, value: np.ndarray, start: int) -> np.ndarray:
    """The value before each token in its row, `start` before the first."""
    out = np.full(len(value), start, value.dtype)
    same = row[1:] == row[:-1]
    out[1:][same] = value[:-1][same]
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among sorted distinct keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Index:
    """Places of keys among sorted distinct hashes, from a table of where those with equal high bits begin."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(1, len(keys).bit_length())
        self.shift, self.size = np.uint64(64 - bits), len(keys)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, ~np.uint64(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """As `_find`."""
        place = self.first[keys >> self.shift]
        seen = self.keys[place]
        low = np.flatnonzero(seen < keys)
        while len(low):
            place[low] += 1
            seen[low] = self.keys[place[low]]
            low = low[seen[low] < keys[low]]
        return np.where((seen == keys) & (place < self.size), place, -1)


def order_of(keys: np.ndarray) -> np.ndarray:
    """The order that sorts hashes, ties by place: their high bits are sorted together with their places, which takes a fourth of the time of argsort."""
    n = len(keys)
    if n < 2:
        return np.zeros(n, np.int64)
    low = keys.min()
    bits = np.uint64((n - 1).bit_length())
    spread = np.uint64(64 - max(1, int(keys.max() - low).bit_length()))
    packed = (((keys - low) << spread) >> bits << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = keys[order]
    # Hashes that differ in their low bits alone.
    return np.argsort(keys, kind="stable") if (found[1:] < found[:-1]).any() else order


@dataclass
class Grams:
    """Frequent words by ascending hash, and for each further length the sorted codes of frequent runs.

    The code of a run is (place of the run without its last word) * words + (place of its last word).
    """

    words: np.ndarray
    counts: np.ndarray
    codes: list[np.ndarray] = field(default_factory=list)
    numbers: list[np.ndarray] = field(default_factory=list)

    def places(self, row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Of each token the place of its word; for each length the place of the run that ends before it; that of the longest run that ends with it."""
        h = len(self.words)
        word = here = _find(self.words, token)
        before = [_shifted(row, word, int(_find(self.words, np.array([END]))[0]))]
        for known in self.codes:
            code = np.where((before[-1] >= 0) & (word >= 0) & (here >= 0), before[-1] * h + word, -1)
            here = np.where(code >= 0, _find(known, code), -1)
            before.append(_shifted(row, here, -1))
        return word, before, here

    def next_codes(self, row: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Codes of the runs one longer than the known ones whose both parts are frequent (no other can be)."""
        word, before, here = self.places(row, token)
        ok = (before[-1] >= 0) & (here >= 0)
        return before[-1][ok] * len(self.words) + word[ok]


@dataclass
class Level:
    """States of one context length: by place of the run the log10 of its left-over mass (nan: no state); transitions by code."""

    rest: np.ndarray
    codes: np.ndarray
    gain: np.ndarray


@dataclass
class Tree:
    grams: Grams
    levels: list[Level]
    states: int

    def gains(self, row: np.ndarray, token: np.ndarray) -> np.ndarray:
        """For each token log10 of its probability in its longest suffix state, less that at the root."""
        word, before, _ = self.grams.places(row, token)
        h = len(self.grams.words)
        total, open_ = np.zeros(len(row)), np.ones(len(row), bool)
        for level, run in zip(reversed(self.levels), reversed(before[: len(self.levels)]), strict=True):
            at = np.flatnonzero(open_ & (run >= 0))
            at = at[~np.isnan(level.rest[run[at]])]
            known = at[word[at] >= 0]
            place = _find(level.codes, run[known] * h + word[known])
            hit = place >= 0
            total[known[hit]] += level.gain[place[hit]]
            open_[known[hit]] = False
            missed = at[open_[at]]
            total[missed] += level.rest[run[missed]]
        return total


def grow(grams: Grams, n: int, v: int) -> Tree:
    """Keep the contexts that pass the divergence test, shortest first.

    In a context s seen n(s) times, a frequent word w has probability (n(s, w) - DISCOUNT) / n(s) + rest(s) * p(w | suffix), any other
    word rest(s) * p(w | suffix), where rest(s) is what is left of 1: a distribution if that of the suffix is one. The suffix is the longest
    state that ends s. The divergence is the mean over the occurrences of s of log(p(w | s) / p(w | suffix)).
    """
    h = len(grams.words)
    root = np.log((grams.counts + 1) / (n + v + 1))
    levels: list[Level] = []
    end = _find(grams.words, np.array([END]))[0] if h else -1
    # For each run that may be a context: its number, the place of the run without its first word, and its last word.
    number, suffix = grams.counts.astype(float), np.full(h, -1, np.int64)
    states = 1

    def log_gain(depth: int, run: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log(p(word | run) / root) by the levels below `depth`; run: place among runs of length depth (depth 0: none)."""
        total, open_ = np.zeros(len(word)), np.ones(len(word), bool)
        for d in range(depth, 0, -1):
            level = levels[d - 1]
            ok = open_ & (run >= 0)
            ok[ok] = ~np.isnan(level.rest[run[ok]])
            place = np.where(ok, _find(level.codes, run * h + word), -1)
            hit = place >= 0
            total[hit] += level.gain[place[hit]] * math.log(10)
            open_[hit] = False
            missed = ok & open_
            total[missed] += level.rest[run[missed]] * math.log(10)
            if d > 1:
                run = np.where(run >= 0, suffixes[d - 1][run], -1)
        return total

    suffixes: list[np.ndarray] = []
    for depth, (codes, numbers) in enumerate(zip(grams.codes, grams.numbers, strict=True)):
        suffixes.append(suffix)
        run, word = codes // h, codes % h
        short = suffix[run] if depth else np.full(len(run), -1, np.int64)
        parent = log_gain(depth, short, word)
        share = (numbers - DISCOUNT) / number[run]
        rest = 1 - np.bincount(run, share, len(number))
        rest = np.clip(rest, 1e-12, 1)
        gain = np.log(share + rest[run] * np.exp(parent + root[word])) - root[word]
        better = np.bincount(run, numbers * (gain - parent), len(number))
        seen = np.bincount(run, numbers, len(number))
        divergence = (better + np.maximum(number - seen, 0) * np.log(rest)) / np.maximum(number, 1)
        keep = (divergence >= DIVERGENCE) & (seen > 0)
        states += int(keep.sum())
        levels.append(Level(np.where(keep, np.log10(rest), np.nan), codes[keep[run]], gain[keep[run]] / math.log(10)))
        # The runs of the next length that may be contexts: nothing follows an END.
        lower = suffix[run] if depth else word
        follow = np.where(lower >= 0, lower * h + word, -1) if depth else word
        suffix = (_find(grams.codes[depth - 1], follow) if depth else follow).astype(np.int64)
        number = numbers.astype(float).copy()
        number[word == end] = np.maximum(number[word == end], 1)
    return Tree(grams, levels, states)


def run_keys(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a run, by those of the run without its last word and of the run without its first."""
    return mix(context * np.uint64(0xD1342543DE82EF95) + suffix)


def runs_of(row: np.ndarray, token: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 1: row, hash without the last word, hash without the first and hash of the runs that end at each token.

    An END stands before the first word of a row. A single word has no context (0) and is its own suffix.
    """
    yield row, np.zeros(len(row), np.uint64), token, token
    context, suffix = _shifted(row, token, END), token
    context[np.flatnonzero(np.diff(row, prepend=-1))] = END
    for length in range(2, longest + 1):
        key = run_keys(context, suffix)
        yield row, context, suffix, key
        if length < longest:
            same = row[1:] == row[:-1]
            row, context, suffix = row[1:][same], key[:-1][same], key[1:][same]


def _written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: numbers are read from there with less time than from a checkpoint, and take half the disk."""
    path = scratch(df.sparkSession, "tree")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass
class Filter:
    """Holds for all of its keys, and for few others: a key sets three bits of one word."""

    words: np.ndarray

    @staticmethod
    def codes(key: np.ndarray, words: int) -> np.ndarray:
        """The place of the word, then of three bits in it, six bits each."""
        return key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 18 - (words.bit_length() - 1))

    @staticmethod
    def masks(code: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        return one << (code & low) | one << (code >> np.uint64(6) & low) | one << (code >> np.uint64(12) & low)

    def has(self, key: np.ndarray) -> np.ndarray:
        code = self.codes(key, len(self.words))
        mask = self.masks(code)
        return self.words[code >> np.uint64(18)] & mask == mask


def _filter(keys: DataFrame) -> Filter:
    """The filter of `key`, or of key and `source` if there is one; its size follows the number of keys, up to FILTER_MOST. Tasks hand codes on packed."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, FILTER_SHARE * keys.count()))
    words = 1 << ((bits - 1).bit_length() - 6)
    size = words // FILTER_PARTS

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            key = batch.column("key").to_numpy().view(np.uint64)
            if "source" in batch.schema.names:
                key = of_source(key, batch.column("source").to_numpy().astype(np.uint64))
            code = np.unique(Filter.codes(key, words))
            cut = np.searchsorted(code, np.arange(FILTER_PARTS + 1, dtype=np.uint64) * np.uint64(size << 18)).tolist()
            own = [p for p in range(FILTER_PARTS) if cut[p] < cut[p + 1]]
            packed = [_pack(code[cut[p] : cut[p + 1]] - np.uint64(p * size << 18)) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], ["part", "codes"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > HELD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def fill(part: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        code = np.unique(np.concatenate([_unpack(x, np.uint64) for x in frame["codes"]]))
        word = (code >> np.uint64(18)).astype(np.int64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(size, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(Filter.masks(code), first)
        return pd.DataFrame({"part": [part[0]], "words": [out.tobytes()]})

    out = np.zeros(words, np.uint64)
    columns = [c for c in ("key", "source") if c in keys.columns]
    parts = keys.select(*columns).mapInArrow(coded, "part int, codes binary").groupBy("part")
    for r in parts.applyInPandas(fill, "part int, words binary").toLocalIterator():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["words"], np.uint64)
    return Filter(out)


def of_source(key: np.ndarray, source: np.ndarray | int) -> np.ndarray:
    """The hash of a run and of the task that hands its parts on."""
    return mix(key ^ (np.atleast_1d(source).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def _squeezed(data: bytes) -> bytes:
    """Compressed with a code for single bytes, which Spark's own compression of a shuffle has not."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _loosened(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte from the lowest, so that high bytes, which are mostly equal, cost little once compressed."""
    return _squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_loosened(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences."""
    return _planes(np.diff(values, prepend=values.dtype.type(0)))


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unplanes(data, kind), dtype=kind)


class _Held:
    """Rows of equal columns, the first a key, of which only the first with each key is kept whenever there are more than HELD of them."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, *columns: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """What has to leave, if there was not enough room."""
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size <= HELD:
            return None
        firsts = self.take()
        if len(firsts[0]) > HELD // 2:
            return firsts
        self.parts, self.size = [firsts], len(firsts[0])
        return None

    def take(self) -> tuple[np.ndarray, ...] | None:
        if not self.size:
            return None
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        order = order_of(columns[0])
        key = columns[0][order]
        at = order[np.append(True, key[1:] != key[:-1])]
        return tuple(x[at] for x in columns)


#: Rows that a task hands on of the runs of a bucket: their hashes and numbers packed and the task's own number, or the hashes of both their parts.
PASSED = "bucket int, source int, keys binary, n binary, context binary, suffix binary"
COUNTED = "length int, bucket int, source int, key long, context long, suffix long, n long"


def _dealt(buckets: int, key: np.ndarray, columns: dict) -> pa.RecordBatch:
    """A row for each bucket of the ascending keys; `columns` makes bytes of a part of the runs, by name."""
    edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)
    cut = [0, *np.searchsorted(key, edges).tolist(), len(key)]
    own = [(b, slice(cut[b], cut[b + 1])) for b in range(buckets) if cut[b] < cut[b + 1]]
    made = [[columns[c](x) for _, x in own] if c in columns else [None] * len(own) for c in ("keys", "n", "context", "suffix")]
    source = [TaskContext.get().partitionId()] * len(own)
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in own], pa.int32()), pa.array(source, pa.int32()), *[pa.array(x, pa.binary()) for x in made]],
        ["bucket", "source", "keys", "n", "context", "suffix"],
    )


def _packed(buckets: int, key: np.ndarray) -> pa.RecordBatch:
    key, n = np.unique(key, return_counts=True)
    return _dealt(buckets, key, {"keys": lambda x: _pack(key[x]), "n": lambda x: _planes(n[x].astype(np.uint32))})


def _parts(buckets: int, key: np.ndarray, context: np.ndarray, suffix: np.ndarray) -> pa.RecordBatch:
    return _dealt(buckets, key, {"context": lambda x: context[x].tobytes(), "suffix": lambda x: suffix[x].tobytes()})


def _summed(frame: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and number of the runs of a bucket that come at least `least` times, and one of the tasks that have it, dealt by its hash."""
    packed = frame[frame["keys"].notna()]
    if not len(packed):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    parts = [_unpack(x, np.uint64) for x in packed["keys"]]
    source = np.repeat(packed["source"].to_numpy(np.int32), [len(x) for x in parts])
    key = np.concatenate(parts)
    del parts
    n = np.concatenate([_unplanes(x, np.uint32) for x in packed["n"]]).astype(np.int64)
    order = order_of(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.add.reduceat(n[order], at)
    often = total >= least
    times = np.diff(at, append=len(key))[often]
    at, key = at[often], key[at[often]]
    return key, total[often], source[order[at + (key % times.astype(np.uint64)).astype(np.int64)]]


def count_words(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`(key, n)` of all words. A task sums what it reads, sorts the hashes and packs them in a row for each bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                held.append(token_stream(part)[1])
                size += len(held[-1])
                if size > 2 * HELD:
                    yield _packed(buckets, np.concatenate(held))
                    held, size = [], 0
        if size:
            yield _packed(buckets, np.concatenate(held))

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        key, n, _ = _summed(frame, 1)
        return pd.DataFrame({"key": key.view(np.int64), "n": n})

    return texts.mapInArrow(pack, PASSED).groupBy("bucket").applyInPandas(summed, "key long, n long")


def count_runs(
    texts: DataFrame, length: int, longest: int, shorter: DataFrame, known: DataFrame | None = None, buckets: int = BUCKETS, by_all: bool = False
) -> DataFrame:
    """`(length, bucket, source, key, context, suffix, n)`: the runs of `length` that come at least LEAST times, their parts still 0, and those of `known` with theirs.

    `shorter` has the `key` of the frequent runs one word shorter, to which both parts of a frequent run belong. `known` are the
    former for that length (bucket, source, key, n); none for words, which have no parts. The texts are read once for both; runs above
    `longest` are not counted. Of long runs most come once or twice, so the hashes alone are counted, sorted and packed in a
    row for each task and bucket, and the parts are fetched from the texts once it is known which are frequent.

    A run that is everywhere has its parts sent by the task `source` alone, one of those that counted it. If rows came to other tasks since, so
    that some parts are missing, the texts are read again and the parts sent `by_all` tasks that have them.
    """
    share = texts.sparkSession.sparkContext.broadcast
    fetches, counts = known is not None, length <= longest
    bits = share(_filter(shorter.select("key"))) if counts or by_all else None
    own = share(_filter(known.select("key", "source"))) if fetches and not by_all else None

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = bool(bits.value.has(np.array([END]))[0]) if bits else False
        source = TaskContext.get().partitionId()
        parts, held, size = _Held(), [], 0
        for batch in batches:
            for part in slices(batch):
                *_, (row, context, suffix, key) = runs_of(*token_stream(part), length - 1)
                ok = bits.value.has(key) if bits else np.ones(len(key), bool)
                if fetches:
                    at = np.flatnonzero(ok)
                    if own:
                        at = at[own.value.has(of_source(key[at], source))]
                    if len(at) and (full := parts.add(key[at], context[at], suffix[at])):
                        yield _parts(buckets, *full)
                if not counts:
                    continue
                if length == 2:
                    both = ok & _shifted(row, ok, end)
                    found = run_keys(_shifted(row, key, END)[both], key[both])
                else:
                    both = ok[:-1] & ok[1:] & (row[1:] == row[:-1])
                    found = run_keys(key[:-1][both], key[1:][both])
                held.append(found)
                size += len(found)
                if size > 2 * HELD:
                    yield _packed(buckets, np.concatenate(held))
                    held, size = [], 0
        if size:
            yield _packed(buckets, np.concatenate(held))
        if full := parts.take():
            yield _parts(buckets, *full)

    def table(size: int, bucket: int, source: np.ndarray, key: np.ndarray, both: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        columns = {"source": source, "key": key.view(np.int64), "context": both[0].view(np.int64), "suffix": both[1].view(np.int64), "n": n}
        return pd.DataFrame({"length": np.full(len(key), size, np.int32), "bucket": np.full(len(key), bucket, np.int32), **columns})

    def counted(bucket: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        key, n, source = _summed(frame, LEAST)
        return table(length, bucket[0], source, key, np.zeros((2, len(key)), np.uint64), n)

    def matched(bucket: tuple, frame: pd.DataFrame, often: pd.DataFrame) -> pd.DataFrame:
        order = order_of(often["key"].to_numpy(np.int64).view(np.uint64))
        key, n = often["key"].to_numpy(np.int64).view(np.uint64)[order], often["n"].to_numpy(np.int64)[order]
        both, source = np.zeros((2, len(key)), np.uint64), np.full(len(key), -1, np.int32)
        fetched = frame[frame["context"].notna()]
        for context, suffix in zip(fetched["context"], fetched["suffix"], strict=True):
            context, suffix = np.frombuffer(context, np.uint64), np.frombuffer(suffix, np.uint64)
            at = _find(key, run_keys(context, suffix))
            hit = at >= 0
            both[:, at[hit]] = context[hit], suffix[hit]
            source[at[hit]] = 0
        return pd.concat([table(length - 1, bucket[0], source, key, both, n), counted(bucket, frame)])

    rows = texts.mapInArrow(passed, PASSED).groupBy("bucket")
    if not fetches:
        return _written(rows.applyInPandas(counted, COUNTED))
    found = _written(rows.cogroup(known.select("bucket", "key", "n").groupBy("bucket")).applyInPandas(matched, COUNTED))
    if by_all or found.filter((F.col("length") < length) & (F.col("source") < 0)).isEmpty():
        return found
    return count_runs(texts, length, longest, shorter, known, buckets, True)


def next_level(runs: DataFrame, shorter: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`runs` with `parent` and `logp`, the log-probability of the last word by the context's suffix and by the tree so far, and `rest` and `state` of
    the context; and the contexts: `(context, n, rest, state)`.

    `shorter(key, n, logp)` holds both parts of every run. The formulas are those of `grow`.
    """
    left = runs.groupBy("context").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("m"))
    left = left.join(shorter.select(F.col("key").alias("context"), F.col("n").alias("total")), "context")
    share = (F.col("seen") - DISCOUNT * F.col("m")) / F.col("total")
    left = left.select("context", "seen", "total", F.least(F.greatest(1 - share, F.lit(1e-12)), F.lit(1.0)).alias("rest"))
    known = runs.join(shorter.select(F.col("key").alias("suffix"), F.col("logp").alias("parent")), "suffix").drop("suffix").join(left, "context")
    known = _written(known.withColumn("own", F.log((F.col("n") - DISCOUNT) / F.col("total") + F.col("rest") * F.exp("parent"))))
    better = F.sum(F.col("n") * (F.col("own") - F.col("parent")))
    unseen = F.greatest(F.first("total") - F.first("seen"), F.lit(0)) * F.log(F.first("rest"))
    state = ((better + unseen) / F.first("total") >= DIVERGENCE).alias("state")
    tested = _written(known.groupBy("context").agg(F.first("seen").alias("n"), F.first("rest").alias("rest"), state))
    known = known.join(tested.select("context", "state"), "context").withColumn("logp", F.when(F.col("state"), F.col("own")).otherwise(F.col("parent")))
    return _written(known.select("key", "n", "parent", "logp", "rest", "state")), tested


def level_gains(level: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(key, gain, n)`: what a state adds (log10) to the score wherever it is the context, and what each of its transitions adds to that.

    So the score of a text is the sum over its runs of all lengths, each found by itself.
    """
    ten = math.log(10)
    states = contexts.filter("state").select(F.col("context").alias("key"), (F.log("rest") / ten).alias("gain"), "n")
    return states, level.filter("state").select("key", ((F.col("logp") - F.col("parent") - F.log("rest")) / ten).alias("gain"), "n")


def hottest(values: DataFrame, most: int) -> dict[str, np.ndarray]:
    """`key` (sorted), `base`, `gain` and `known` of the words and runs from some frequency on, `most` at most; the last of each column is for none."""
    step = F.floor(F.log2("n") * 4)
    upto, least = 0, None
    for r in values.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect():
        upto += r["count"]
        if upto > most:
            break
        least = r["step"]
    kept = values.filter(step >= least) if least is not None else values.limit(0)
    found = kept.select("key", "base", "gain", "known").toArrow()
    key = found.column("key").to_numpy().view(np.uint64)
    order = order_of(key)
    return {"key": key[order], **{c: np.append(found.column(c).to_numpy().astype(float)[order], 0.0) for c in ("base", "gain", "known")}}


def _sums(docs: DataFrame, values: DataFrame, longer: DataFrame, buckets: int, longest: int) -> DataFrame:
    """`(key, n_tokens, base, gain, known)` of each document: the sums over its runs of `values(key, base, gain, known, n)`.

    The values of the HOT most frequent words and runs are in every task, so a run that is everywhere stays where it is. A document's other
    runs go once over the network, by bucket, in blocks; `longer` has the `key` of the runs of two words and more that have a value.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_filter(longer))
    hot = docs.sparkSession.sparkContext.broadcast(hottest(values, HOT))
    # The more buckets, the larger the slices, so that the sums of a document do not travel in ever more parts; a row has 16 bits.
    scale = min(SLICES, -(-buckets // BUCKETS))
    # Only words have a base and are known.
    of_words, of_runs = ((0, "base"), (1, "gain"), (2, "known")), ((1, "gain"),)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        index = Index(hot.value["key"])
        for batch in batches:
            for part in slices(batch, most=scale * SLICE_BYTES, rows=scale * SLICE_ROWS):
                row, token = token_stream(part)
                rows, keys = [], []
                own_sums = np.zeros((3, part.num_rows))
                for length, (r, _, _, key) in enumerate(runs_of(row, token, longest), 1):
                    if length > 1:
                        ok = bits.value.has(key)
                        r, key = r[ok], key[ok]
                    place = index.find(key)
                    for i, c in of_runs if length > 1 else of_words:
                        own_sums[i] += np.bincount(r, hot.value[c][place], part.num_rows)
                    rows.append(r[place < 0])
                    keys.append(key[place < 0])
                n = np.bincount(row, minlength=part.num_rows)
                row, key = np.concatenate(rows), np.concatenate(keys)
                order = order_of(key)
                row, key = row[order].astype(np.uint16), key[order]
                cut = np.searchsorted((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                ids = np.concatenate([part.column("key").to_numpy(), n]).astype(np.int64).tobytes()
                out = []
                # What a slice has in hand goes to a bucket of its own choice.
                head = int(mix(np.array([number], np.uint64))[0] % np.uint64(buckets))
                for b in np.union1d(np.flatnonzero(cut[1:] > cut[:-1]), [head]).tolist():
                    own = slice(cut[b], cut[b + 1])
                    out.append((b, number, _planes(row[own]), _pack(key[own]), ids if b == head else None, own_sums.tobytes() if b == head else None))
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)],
                    ["bucket", "slice", "row", "token", "ids", "own"],
                )

    def weigh(frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        # Keys of a bucket have equal high bits, by which an index is made.
        spread = np.uint64(0x9E3779B97F4A7C15)
        known = table["key"].to_numpy(np.int64).view(np.uint64) * spread
        order = order_of(known)
        index = Index(known[order])
        value = {c: np.append(table[c].to_numpy(float)[order], 0.0) for c in ("base", "gain", "known")}
        out = []
        for s, row, token, ids, own in zip(*(frame[c] for c in ("slice", "row", "token", "ids", "own")), strict=True):
            place = index.find(_unpack(token, np.uint64) * spread)
            hit = place >= 0
            row, place = _unplanes(row, np.uint16)[hit], place[hit]
            rows = np.flatnonzero(np.bincount(row))
            sums = [np.bincount(row, value[c][place])[rows] for c in ("base", "gain", "known")]
            if len(rows) or isinstance(ids, bytes):
                packed = [_squeezed(x.tobytes()) for x in (rows.astype(np.uint16), sums[0], sums[1], sums[2].astype(np.uint32))]
                out.append((s, *packed, ids, own))
        return pd.DataFrame(out, columns=["slice", "rows", "base", "gain", "known", "ids", "own"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        ids, own = next((i, x) for i, x in zip(frame["ids"], frame["own"], strict=True) if i is not None)
        keys, n = np.frombuffer(ids, np.int64).reshape(2, -1)
        base, gain, known = np.frombuffer(own).reshape(3, -1).copy()
        known = known.astype(np.int64)
        # Always in the same order, so that sums are the same in every run.
        for rows, b, g, k in sorted(zip(frame["rows"], frame["base"], frame["gain"], frame["known"], strict=True)):
            at = np.frombuffer(_loosened(rows), np.uint16)
            base[at] += np.frombuffer(_loosened(b))
            gain[at] += np.frombuffer(_loosened(g))
            known[at] += np.frombuffer(_loosened(k), np.uint32)
        return pd.DataFrame({"key": keys, "n_tokens": n, "base": base, "gain": gain, "known": known})

    parts = docs.select("key", "text").mapInArrow(split, "bucket int, slice long, row binary, token binary, ids binary, own binary")
    dealt = values.drop("n").withColumn("bucket", F.expr(f"int(shiftrightunsigned(shiftrightunsigned(key, 32) * {buckets}L, 32))"))
    schema = "slice long, rows binary, base binary, gain binary, known binary, ids binary, own binary"
    found = parts.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(weigh, schema)
    return found.groupBy("slice").applyInPandas(joined, "key long, n_tokens long, base double, gain double, known long")


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states.

    `base_score` is the sum over tokens of log10((c + 1) / (N + V + 1)); `score` the log10 probability by the tree. Null and empty
    texts are one END. Words that training never saw count 0 and have the root's probability for an unseen word. Rows may
    repeat; other columns do not matter. Without training rows N and V are 0, and the tree is its root.

    Every word of every text is counted, and every longer run that comes LEAST times; nothing but bitmaps of fixed size and two sums
    meets in the driver. Runs are known by 64-bit hashes.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), in_training().alias("train"))
    given = given.withColumn("key", F.xxhash64("doc_id", "text"))
    size = given.agg(F.sum(F.octet_length("text")).alias("all")).first()
    buckets = max(BUCKETS, math.ceil((size["all"] or 0) / BUCKET_BYTES))
    texts = given.filter("train").select("text")
    words = _written(count_words(texts, buckets))
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    # Rarer words are no part of a run that counts.
    level = _written(words.filter(F.col("n") >= LEAST).withColumn("logp", F.log((F.col("n") + 1) / (n + v + 1))))
    gains, longer, states = [], level.select("key").limit(0), 1
    often = count_runs(texts, 2, depth + 1, level, None, buckets).select("bucket", "source", "key", "n")
    for length in range(2, depth + 2):
        # One reading of the texts fetches the parts of the runs of this length and counts those of the next.
        found = count_runs(texts, length + 1, depth + 1, often, often, buckets)
        runs = found.filter(F.col("length") == length).drop("length", "bucket", "source")
        often = found.filter(F.col("length") > length).select("bucket", "source", "key", "n")
        level, contexts = next_level(runs, level)
        of_states, of_runs = level_gains(level, contexts)
        gains += [of_states, of_runs]
        longer = longer.unionByName((of_runs if length == 2 else of_states.unionByName(of_runs)).select("key"))
        states += of_states.count()
    zero = F.lit(0.0)
    of_words = words.select("key", F.log10(F.col("n") + 1).alias("base"), zero.alias("gain"), F.lit(1).alias("known"), "n")
    values = of_words.filter(F.col("n") >= LEAST)
    for found in gains:
        values = values.unionByName(found.select("key", zero.alias("base"), "gain", F.lit(0).alias("known"), "n"))
    sums = [F.sum(c).alias(c) for c in ("base", "gain", "known")]
    # Rarer words are no contexts, so they have no other value.
    values = _written(values.groupBy("key").agg(*sums, F.max("n").alias("n"))).unionByName(of_words.filter(F.col("n") < LEAST))
    # Rows that are equal have one key: each adds the same to the sums.
    sums = _sums(given, values, longer, buckets, depth + 1).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n_tokens", "base", "gain", "known")])
    base_score = F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)
    return given.select("doc_id", "train", "key").join(sums, "key").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), (base_score + F.col("gain")).alias("score"), F.lit(states).cast("long").alias("n_states"),
    )
