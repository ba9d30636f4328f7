"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. A trigram's vector binds (multiplies) those of its letters, the first permuted twice
and the second once; a text's vector bundles (adds) those of its trigrams. A language's prototype bundles texts labelled with
it, each scaled to length 1. A document has the language of the prototype of the highest cosine.

Letters are code points in lower case; anything else counts as one space, also at both ends, and runs of it as one.

Cases: a null text has a null language and score; a text without letters has language "und" and score 0; ties go to the language first in
order; rows with a null label aren't learned from; with no labelled rows every text is "und"; null and repeated ids are
identified row by row; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col
from .kernels import slices

DIMENSIONS = 1024
#: Labelled rows of each language that its prototype is made of, at most.
SAMPLE_ROWS = 4000
#: Trigram vectors that a worker remembers; a bound on memory, not on what is counted.
REMEMBERED = 40_000
SPACE = 32


@lru_cache(1)
def _folding() -> np.ndarray:
    """Lower-case letter of each code point, SPACE if it isn't a letter."""
    out = np.full(0x110000, SPACE, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """Signs that depend on nothing but the code point."""
    lanes = np.arange(dimensions, dtype=np.uint64)[None, :]
    x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + lanes * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.where((x >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int8)


def trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    first, second, third = codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF
    points, where = np.unique(np.concatenate((first, second, third)), return_inverse=True)
    letters = letter_vectors(points, dimensions)
    a, b, c = np.split(where.ravel(), 3)
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


class Bundler:
    """Vectors of texts, with the trigrams' vectors remembered between batches."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.codes, self.vectors = np.zeros(0, np.int64), np.zeros((0, dimensions), np.int8)

    def _learn(self, codes: np.ndarray) -> None:
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            if len(self.codes) + len(new) > REMEMBERED:
                self.codes, self.vectors, new = np.zeros(0, np.int64), np.zeros((0, self.dimensions), np.int8), codes
            codes = np.concatenate((self.codes, new))
            order = np.argsort(codes)
            self.vectors = np.concatenate((self.vectors, trigram_vectors(new, self.dimensions)))[order]
            self.codes = codes[order]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        joined = "\n" + "\n".join(t or "" for t in texts) + "\n"
        points = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.array([len(t or "") + 1 for t in texts], np.int64))
        row = np.append(row, len(texts))  # each text with the line end before it
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE) | (row[1:] != row[:-1])
        points, row = points[keep], row[keep]
        code = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
        # A trigram belongs to the text of its middle letter; none has a space there, or spans two texts but for the space at their border.
        good = points[1:-1] != SPACE
        code, row = code[good], row[1:-1][good]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if not len(code):
            return out
        known, index = np.unique(code, return_inverse=True)
        index = index.ravel()
        self._learn(known)
        place = np.searchsorted(self.codes, known)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        vectors, n = self.vectors, len(known)
        for k in range(len(texts)):
            mine = index[bounds[k] : bounds[k + 1]]
            if len(mine):
                counts = np.bincount(mine, minlength=n)
                have = np.flatnonzero(counts)
                out[k] = counts[have].astype(np.float32) @ vectors[place[have]].astype(np.float32)
        return out


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from at most sample_rows labelled rows of each language (those of the lowest hash of id, label
    and text)."""
    labelled = df.select(col(text_col).alias("text"), col(lang_col).alias("lang"), col(id_col).alias("id")).filter("text is not null and lang is not null")
    labelled = labelled.withColumn("h", F.xxhash64("id", "lang", "text"))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            which, h = names.indices.to_numpy(), batch.column(1).to_numpy()
            for k, lang in enumerate(names.dictionary.to_pylist()):
                least[lang] = np.sort(np.concatenate((least.get(lang, np.zeros(0, np.int64)), h[which == k])))[:sample_rows]
        for lang, h in least.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h)], ["lang", "h"])

    # The hashes of the rows to take are found among narrow rows first, so few texts are sorted.
    order = Window.partitionBy("lang").orderBy("h")
    few = labelled.select("lang", "h").mapInArrow(lowest, "lang string, h bigint").withColumn("place", F.row_number().over(order))
    lasts = few.filter(F.col("place") <= sample_rows).groupBy("lang").agg(F.max("h").alias("last")).collect()
    if not lasts:
        return [], np.zeros((0, dimensions), np.float32)
    last = F.broadcast(df.sparkSession.createDataFrame(lasts, "lang string, last bigint"))
    # Equal rows have equal hashes; of these, no more than are left are taken.
    taken = labelled.join(last, "lang").filter("h <= last").withColumn("place", F.row_number().over(order))
    sample = taken.filter(F.col("place") <= sample_rows).select("text", "lang")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        bundler = Bundler(dimensions)
        for batch in slices(batches, 0, 1 << 20):
            v = bundler.bundle(batch.column(0).to_pylist()).astype(float)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            for lang, x in zip(batch.column(1).to_pylist(), v, strict=True):
                sums[lang] = sums.get(lang, 0.0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts: pd.DataFrame = sample.mapInArrow(stage, "lang string, v array<double>").toPandas()
    total = {lang: np.sum(np.stack(sorted(g.v.tolist(), key=lambda x: tuple(x[:8]))), 0) for lang, g in parts.groupby("lang")}
    langs = sorted(total)
    out = np.stack([total[lang] for lang in langs])
    return langs, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def identify(df: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, cosine and lead over the next language of every text: doc_id, language, score, lead."""
    dimensions = prototypes.shape[1]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions)
        names = np.array([*langs, "und"], object)
        for batch in slices(batches, 1, 1 << 20):
            v = bundler.bundle(batch.column(1).to_pylist())
            norm = np.linalg.norm(v, axis=1)
            cosine = np.full((len(v), max(2, len(langs))), -1.0)
            if langs:
                cosine[:, : len(langs)] = v @ prototypes.T / np.maximum(norm, 1e-12)[:, None]
            best = cosine.argmax(1)
            none = (norm == 0) | (not langs)
            best[none] = len(langs)
            top = np.sort(cosine, axis=1)[:, -2:]
            score, lead = np.where(none, 0.0, top[:, 1]), np.where(none, 0.0, top[:, 1] - top[:, 0])
            void = np.asarray(batch.column(1).is_null().to_numpy(zero_copy_only=False), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string(), mask=void), pa.array(score, mask=void), pa.array(lead, mask=void)], ["doc_id", "language", "score", "lead"])

    kind = df.select(col(id_col)).schema[0].dataType.simpleString()
    return df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(stage, f"doc_id {kind}, language string, score double, lead double")
