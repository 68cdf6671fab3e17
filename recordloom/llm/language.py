"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import mix, slices

#: Bits of a vector, as WORDS unsigned 64-bit integers.
DIM = 1024
WORDS = DIM // 64
#: Unit vectors are summed as integers of this scale, so that sums do not depend on their order.
SCALE = 1 << 20
#: Cells of a table of trigram counts.
CELLS = 1 << 22
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The random bit vector of each code point, by a hash of the code point: the same in every task."""
    seeds = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(seeds)


def permuted(bits: np.ndarray) -> np.ndarray:
    """One fixed permutation of the components: words move on by one, bits inside a word by one."""
    moved = np.roll(bits, 1, axis=1)
    return moved << np.uint64(1) | moved >> np.uint64(63)


def gram_vectors(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """+1 / -1 vectors of trigrams: the letters' vectors, permuted by place, bound by exclusive or."""
    bound = permuted(permuted(letter_vectors(first)) ^ letter_vectors(second)) ^ letter_vectors(third)
    bits = np.unpackbits(np.ascontiguousarray(bound).view(np.uint8), axis=1)
    return 1.0 - 2.0 * bits.astype(np.float32)


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled unit vector of each text, and whether it has a letter (else the vector is zero).

    Texts are in lower case; a run of anything but letters is one space, and a space stands before and after the text.
    """
    joined = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    codes = np.concatenate(joined)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in joined])
    letter = letters()[codes]
    has = np.bincount(row, letter, len(texts)) > 0
    codes = np.where(letter, codes, 0x20)
    stay = letter.copy()
    stay[0] = True
    stay[1:] |= letter[:-1] | (row[1:] != row[:-1])
    codes, row = codes[stay], row[stay]
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    p, a = place[codes], len(alphabet)
    same = row[:-2] == row[2:]
    key = ((p[:-2] * a + p[1:-1]) * a + p[2:])[same]
    row = row[:-2][same]
    if a**3 <= CELLS:
        found = np.zeros(a**3, bool)
        found[key] = True
        grams = np.flatnonzero(found)
        number = np.zeros(a**3, np.int64)
        number[grams] = np.arange(len(grams))
        at = number[key]
    else:
        grams, at = np.unique(key, return_inverse=True)
    out = np.zeros((len(texts), DIM), np.float32)
    if not len(grams):
        return out, has
    rows = max(1, CELLS // len(grams))
    for lo in range(0, len(grams), CELLS // DIM):
        part = grams[lo : lo + CELLS // DIM]
        vectors = gram_vectors(alphabet[part // a // a], alphabet[part // a % a], alphabet[part % a])
        for begin in range(0, len(texts), rows):
            some = slice(*np.searchsorted(row, [begin, begin + rows]))
            inside = (at[some] >= lo) & (at[some] < lo + len(part))
            n = min(rows, len(texts) - begin)
            cell = (row[some][inside] - begin) * len(part) + at[some][inside] - lo
            counts = np.bincount(cell, minlength=n * len(part)).reshape(n, len(part)).astype(np.float32)
            out[begin : begin + n] += counts @ vectors
    length = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.where(length > 0, length, 1)
    out[~has] = 0
    return out, has


@dataclass
class Profiles:
    """Language names in the order of their code points, and a unit vector for each."""

    names: list[str]
    vectors: np.ndarray


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0


def fit_profiles(docs: DataFrame) -> Profiles:
    """Prototypes from (text, lang) of all rows whose lang is not null and whose text has a letter.

    Every task bundles its rows by language; sums by language and component follow in Spark. One vector for each language is
    collected, so the languages, not the documents, bound it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                vectors, has = bundles(part.column("text").to_pylist())
                names = np.array(part.column("lang").to_pylist(), object)
                whole = np.rint(vectors[has].astype(float) * SCALE).astype(np.int64)
                for name in dict.fromkeys(names[has]):
                    sums[name] = sums.get(name, 0) + whole[names[has] == name].sum(0)
        for name, total in sums.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"lang": name, "i": np.arange(DIM, dtype=np.int32), "value": total}), preserve_index=False)

    rows = docs.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, i int, value long")
    found = rows.groupBy("lang", "i").agg(F.sum("value").alias("value")).collect()
    names = sorted({r["lang"] for r in found}, key=str.encode)
    vectors = np.zeros((len(names), DIM))
    for r in found:
        vectors[names.index(r["lang"]), r["i"]] = r["value"]
    # What all languages share says nothing about one of them.
    if len(names) > 1:
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
        vectors = unit - unit.mean(0)
    return Profiles(names, (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """Columns `keep` with `lang_pred` and `score`: the nearest profile and its cosine, cut to 0..1.

    Null texts, texts without a letter, and all texts if no profile was learned, are `und` with score 0. Ties go to the first name
    in the order of code points. One row per row; only the text is an input.
    """
    given = docs.select(*[F.col(c) if isinstance(c, str) else c for c in keep], F.col("text").alias("_text"))
    names = [f.name for f in given.schema.fields[:-1]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + ["lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                lang, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if profiles.names:
                    vectors, has = bundles(pc.fill_null(part.column("_text"), "").to_pylist())
                    cosine = vectors @ profiles.vectors.T
                    best = cosine.argmax(1)
                    lang[has] = np.array(profiles.names, object)[best[has]]
                    score[has] = np.clip(cosine[np.arange(len(best)), best], 0, 1)[has]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"]
                )

    return given.mapInArrow(run, schema)
