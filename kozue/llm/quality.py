"""Quality and toxicity classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round the features, and for each fits a shallow tree to the gradients by
bin; the trees of a feature add up to one lookup table. Then the pairs of features that explain most of the remaining gradient
get tables of their own. A document's score is the sum of its tables' entries, looked up for a whole batch at once.

Features are measures of the text, and hits in a lexicon of byte 5-grams and words that are much more frequent in toxic than in
other labelled documents. The model is fitted on the driver, from the binned features of a sample of at most `sample_rows`
labelled rows (those of the lowest hash of their id; of rows that share an id, the one of the least text); all documents are scored.

Cases: a text that is null or has no word is rejected with quality 0 and toxicity 0; labels that are null are left out, and
of repeated labels of an id the lowest counts (the highest for toxicity); labels of one class only give a constant score; with no
labels quality is 1 and toxicity 0; null and repeated ids are scored row by row; extra columns don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, col, numbered
from .kernels import U64, Words, letter_table, slices, text_buffers, whitespace_table

SAMPLE_ROWS = 20_000
BUCKET_BITS = 20
LEXICON_SIZE = 4000
FEATURES = ("log_bytes", "upper", "symbol", "digit", "word_bytes", "distinct", "repeat", "most_frequent", "symbol_pairs", "lines", "hits", "hit_rate", "hit_kinds")
BINS, GRID, PAIRS = 32, 8, 6

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_ascii = np.arange(256)
_UPPER = (_ascii >= 65) & (_ascii < 91)
_DIGIT = (_ascii >= 48) & (_ascii < 58)
_BLANK = np.isin(_ascii, list(b" \t\n\r\f\v"))
_LETTER = _UPPER | ((_ascii >= 97) & (_ascii < 123)) | (_ascii >= 128)
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK) & ~np.isin(_ascii, list(b".,;:'\"()-?"))


def lexicon_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 5-grams within words and of the words, and their rows."""
    low = _lower[data]
    word = _LETTER[data]
    n = len(data)
    words = Words(data, offsets, letter_table())
    rows, units = [words.row()], [(words.hash >> U64(64 - BUCKET_BITS)).astype(np.int64)]
    if n >= 5:
        inside = np.ones(n - 4, bool)
        code = np.zeros(n - 4, np.uint64)
        for k in range(5):
            inside &= word[k : n - 4 + k]
            code = code << U64(8) | low[k : n - 4 + k].astype(np.uint64)
        at = np.flatnonzero(inside)
        row = np.searchsorted(offsets, at, side="right") - 1
        whole = at + 5 <= offsets[row + 1]
        at, row = at[whole], row[whole]
        rows.append(row)
        units.append(((code[at] * U64(0x9E3779B97F4A7C15)) >> U64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(units), np.concatenate(rows)


def features(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; lexicon: whether a bucket is in it."""
    data, offsets = text_buffers(texts)
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def per(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    some = np.maximum(size, 1)
    symbol = _SYMBOL[data]
    letters = np.maximum(per(_LETTER[data]), 1)
    words = Words(data, offsets, whitespace_table())
    row = words.row()
    count = np.diff(words.first).astype(float)
    total = np.maximum(count, 1)
    again = np.zeros(len(row))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words.hash, row))
    r, h = row[order], words.hash[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))) if len(r) else np.zeros(0, int)
    run = np.diff(np.append(new, len(r)))
    most = np.zeros(rows)
    np.maximum.at(most, r[new], run)
    units, unit_row = lexicon_units(data, offsets)
    found = lexicon[units]
    hits = np.bincount(unit_row[found], minlength=rows).astype(float)
    kinds = np.bincount(np.unique(unit_row[found] << BUCKET_BITS | units[found]) >> BUCKET_BITS, minlength=rows).astype(float)
    pairs = np.concatenate(([False], symbol[1:] & symbol[:-1])) if len(data) else symbol
    pairs[offsets[:-1][size > 0]] = False  # the one before is of another text
    return np.column_stack(
        [
            np.log1p(size),
            per(_UPPER[data]) / letters,
            per(symbol) / some,
            per(_DIGIT[data]) / some,
            size / total,
            np.bincount(r[new], minlength=rows) / total,
            np.bincount(row, again, rows) / total,
            most / total,
            per(pairs) / some,
            per(data == 10) / total,
            np.log1p(hits),
            hits / total,
            np.log1p(kinds),
        ]
    )


@dataclass
class AdditiveModel:
    """Lookup tables of features and of pairs of features; edges are bin limits."""

    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            out += table[b[:, f]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[b[:, i] * GRID // BINS, b[:, j] * GRID // BINS]
        return 1 / (1 + np.exp(-out))


def _gain(g, h):
    return g * g / (h + 1.0)


def _shallow(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 1.0) -> np.ndarray:
    """Values by bin of the best tree of cuts, for sums of gradients and hessians by bin."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
        gain[(hl < least) | (h.sum() - hl < least)] = -1
        if gain.max() > 1e-9:
            c = int(gain.argmax()) + 1
            return np.concatenate([_shallow(g[:c], h[:c], depth - 1, least), _shallow(g[c:], h[c:], depth - 1, least)])
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def _shallow_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same for a pair: a cut of one feature, and one of the other on each side of it."""
    best, out = -1.0, np.zeros_like(g)
    for c in range(1, len(g)):
        values = np.empty_like(g)
        total = 0.0
        for side in (slice(0, c), slice(c, None)):
            gs, hs = g[side].sum(0), h[side].sum(0)
            values[side] = _shallow(gs, hs, 1, 0.5)[None, :]
            total += (values[side][0] * gs).sum()
        if total > best:
            best, out = total, values
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> AdditiveModel:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else [np.zeros(0)] * len(FEATURES)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 0.5
    model = AdditiveModel(edges, np.zeros((x.shape[1], BINS)), [], np.zeros((0, GRID, GRID)), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    at = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-at))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(x.shape[1]):
            g, h = slopes()
            step = rate * _shallow(np.bincount(b[:, f], g, BINS), np.bincount(b[:, f], h, BINS))
            model.tables[f] += step
            at += step[b[:, f]]
    coarse = b * GRID // BINS
    cells = {(i, j): coarse[:, i] * GRID + coarse[:, j] for i in range(x.shape[1]) for j in range(i)}
    g, h = slopes()
    gain = {k: _gain(np.bincount(c, g, GRID * GRID), np.bincount(c, h, GRID * GRID)).sum() for k, c in cells.items()}
    model.pairs = sorted(gain, key=gain.get, reverse=True)[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), GRID, GRID))
    for _ in range(pair_rounds):
        for k, pair in enumerate(model.pairs):
            g, h = slopes()
            c = cells[pair]
            step = rate * _shallow_pair(np.bincount(c, g, GRID * GRID).reshape(GRID, GRID), np.bincount(c, h, GRID * GRID).reshape(GRID, GRID))
            model.pair_tables[k] += step
            at += step.ravel()[c]
    return model


@dataclass
class Classifier:
    lexicon: np.ndarray  # buckets
    quality: AdditiveModel | None
    toxic: AdditiveModel | None

    def flags(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, bool)
        out[self.lexicon] = True
        return out


def _lexicon(sample: DataFrame, size: int) -> np.ndarray:
    """The buckets of the highest odds; sample: text, toxic."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in slices(batches, 0, 1 << 20):
            units, row = lexicon_units(*text_buffers(batch.column(0)))
            each = np.unique(row.astype(np.int64) << BUCKET_BITS | units)
            toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            rows += np.bincount(toxic, minlength=2)
            np.add.at(seen, (toxic[each >> BUCKET_BITS], each & ((1 << BUCKET_BITS) - 1)), 1)
        at = np.flatnonzero(seen[1] >= 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0][at], rows[0])), pa.array(np.append(seen[1][at], rows[1]))], ["unit", "clean", "toxic"])

    counted = (
        sample.select("text", F.col("toxic").cast("int"))
        .coalesce(8)
        .mapInArrow(stage, "unit bigint, clean bigint, toxic bigint")
        .groupBy("unit")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    rows = counted.filter("unit < 0").first()
    if rows is None or not rows.toxic:
        return np.zeros(0, np.int64)
    odds = ((F.col("toxic") + 0.5) / (rows.toxic + 1)) / ((F.col("clean") + 0.5) / (rows.clean + 1))
    good = counted.filter(f"unit >= 0 and toxic >= {max(4, 0.004 * rows.toxic)}").withColumn("odds", odds).filter("odds >= 12")
    return good.orderBy(F.desc("odds"), "unit").limit(size).select("unit").toPandas().unit.to_numpy(np.int64)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, lexicon_size: int = LEXICON_SIZE) -> Classifier:
    """labels: doc_id, quality, toxic."""
    chosen = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .select(F.col("doc_id").alias("label_id"), "quality", "toxic")
    )
    texts = df.select(col(id_col).alias("id"), col(text_col).alias("text")).filter("text is not null")
    # The sample is bounded by its parameter, so it can go to all executors.
    matched = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id"), "inner")
    # A row an id, so that repeated ids don't exceed the bound.
    sample = matched.groupBy("label_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    return _fit_sample(sample.select("text", (F.col("quality") > 0).alias("quality"), (F.col("toxic") > 0).alias("toxic")), lexicon_size)


def _fit_sample(sample: DataFrame, lexicon_size: int) -> Classifier:
    sample = checkpointed(sample)
    lexicon = _lexicon(sample, lexicon_size)
    flags = Classifier(lexicon, None, None).flags()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            x = features(batch.column(0), flags)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1), batch.column(2)], [*FEATURES, "quality", "toxic"])

    measured: pd.DataFrame = sample.mapInArrow(stage, ", ".join(f"{f} double" for f in FEATURES) + ", quality boolean, toxic boolean").toPandas()
    if measured.empty:
        return Classifier(lexicon, None, None)
    measured = measured.sort_values(list(measured.columns), ignore_index=True)  # so that sums don't depend on how rows arrive
    x = measured[list(FEATURES)].to_numpy()
    return Classifier(lexicon, fit(x, measured.quality.to_numpy(float)), fit(x, measured.toxic.to_numpy(float)))


def _scores(model: Classifier):
    def score(texts: pa.Array, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = features(texts, flags)
        none = x[:, FEATURES.index("distinct")] == 0
        q = model.quality.score(x) if model.quality else np.ones(len(x))
        t = model.toxic.score(x) if model.toxic else np.zeros(len(x))
        return np.where(none, 0.0, q), np.where(none, 0.0, t)

    return score


def classify(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """Scores of all rows: doc_id, quality, toxicity, keep."""
    score = _scores(model)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = model.flags()
        for batch in slices(batches, 1, 1 << 20):
            q, t = score(batch.column(1), flags)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array(t), pa.array((q >= least_quality) & (t < most_toxic))], ["doc_id", "quality", "toxicity", "keep"])

    kind = df.select(col(id_col)).schema[0].dataType.simpleString()
    return df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(stage, f"doc_id {kind}, quality double, toxicity double, keep boolean")


def keep_good(df: DataFrame, model: Classifier, text_col: str = "text", least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """Rows of df that the model keeps."""
    score = _scores(model)
    place = df.columns.index(text_col)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = model.flags()
        for batch in slices(batches, place, 1 << 20):
            q, t = score(batch.column(place), flags)
            yield batch.filter(pa.array((q >= least_quality) & (t < most_toxic)))

    work = numbered(df)
    return work.mapInArrow(stage, work.schema).toDF(*df.columns)
