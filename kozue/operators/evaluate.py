"""Evaluation of parses against gold. Sentences come in pairs: a row holds the gold tokens and the system's, which meet by their
character spans. Kernels over Arrow batches count what agrees, so a sentence never leaves its row and only counts are shuffled.

Pairs have the columns sent (any key), gold, system: arrays of tokens with orth, ws, pos, tag, dep, head, ent_iob, ent_type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType, _parse_datatype_string

from ..plans.flow import Step, counted, field, starts

MISSED = "_"
FIELDS = ("orth", "ws", "pos", "tag", "dep", "head", "ent_iob", "ent_type")
_FLAGS = ("tokens", "tag", "pos", "uas", "las", "pos_uas", "pos_las", "root")
_SUMS = (*_FLAGS, "sentence", "sentence_uas", "sentence_las", "n", "roots", "sentences", "sn", "sroots", "ssentences", "ge", "se", "ent_span", "ent_label")
MEASURES = ("tokens", "tag", "pos", "uas", "las", "pos_uas", "pos_las", "root", "sentence", "sentence_uas", "sentence_las", "ent_span", "ent_label")
#: What the totals of a measure's gold and system items are called, where they aren't tokens.
_TOTALS = {"root": ("roots", "sroots"), **dict.fromkeys(("sentence", "sentence_uas", "sentence_las"), ("sentences", "ssentences")), **dict.fromkeys(("ent_span", "ent_label"), ("ge", "se"))}


def slim(tokens: Column) -> Column:
    """Tokens with the fields that evaluation looks at."""
    return F.transform(tokens, lambda t: F.struct(*[t[n].alias(n) for n in FIELDS]))


def nested(table: DataFrame) -> DataFrame:
    """sent, tokens of a token table (sent, i, fields)."""
    rows = table.groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("i", F.struct(*FIELDS).alias("t")))).alias("x"))
    return rows.select("sent", F.transform("x", lambda x: x["t"]).alias("tokens"))


def paired(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Pairs of sentences (sent, tokens) of two sources; what one of them lacks is null."""
    s = system.select(F.col("sent").alias("s_sent"), slim(F.col("tokens")).alias("system"))
    both = gold.select("sent", slim(F.col("tokens")).alias("gold")).join(s, F.col("sent") == F.col("s_sent"), "full")
    return both.select(F.coalesce("sent", "s_sent").alias("sent"), "gold", "system")


class Side:
    """Tokens of a batch of sentences on end, with their character spans within the sentence."""

    def __init__(self, tokens: pa.ListArray):
        offsets = tokens.offsets.to_numpy().astype(np.int64)
        self.begin = offsets - offsets[0]
        self.size = np.diff(self.begin)
        flat = tokens.flatten()
        self.columns = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        width = self._width("orth")
        whole = width + self._width("ws")
        before = np.cumsum(whole) - whole
        self.first = before - before[np.minimum(self.begin[:-1][self.row], max(0, len(whole) - 1))] if len(whole) else before
        self.last = self.first + width

    def _width(self, name: str) -> np.ndarray:
        return pc.fill_null(pc.utf8_length(self.columns[name]), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def is_root(self) -> np.ndarray:
        return pc.fill_null(pc.equal(pc.utf8_lower(self.columns["dep"]), "root"), False).to_numpy(zero_copy_only=False)

    def head_spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the head of each token begins and ends; -1, -2 for heads that aren't there."""
        head = pc.fill_null(self.columns["head"], -1).to_numpy(zero_copy_only=False).astype(np.int64)
        there = (head >= 0) & (head < self.size[self.row])
        at = np.where(there, head + self.begin[:-1][self.row], 0)
        return (np.where(there, self.first[at], -1), np.where(there, self.last[at], -2)) if len(at) else (at, at)

    def entities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last token of each entity, and its sentence: runs of B or U and what continues them. BILUO and IOB are read alike."""
        iob = pc.fill_null(self.columns["ent_iob"], "O")

        def among(*kinds: str) -> np.ndarray:
            return pc.is_in(iob, pa.array(kinds)).to_numpy(zero_copy_only=False)

        n = len(self.row)
        opened = np.append(False, among("B", "I")[:-1]) & np.append(False, self.row[1:] == self.row[:-1]) if n else np.zeros(0, bool)
        inside = among("B", "I", "L", "U")
        begins = np.flatnonzero(among("B", "U") | (among("I", "L") & ~opened))
        last = begins.copy()
        at = np.flatnonzero(inside)
        np.maximum.at(last, np.searchsorted(begins, at, side="right") - 1, at)
        return begins, last, self.row[begins]


class Aligned:
    """Gold tokens and the system's of the same span."""

    def __init__(self, gold: Side, system: Side):
        self.gold, self.system = gold, system
        key, own = system.row << 32 | system.last, gold.row << 32 | gold.last
        self.to = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
        self.ends = key[self.to] == own if len(key) else np.zeros(len(own), bool)
        self.same = self.ends & (system.first[self.to] == gold.first) if len(key) else self.ends

    def field(self, name: str) -> pa.Array:
        """The system's values at gold tokens, null where there is no token of the same span."""
        return self.system.columns[name].take(pa.array(self.to, pa.int64(), mask=~self.same))

    def equal(self, name: str, lower: bool = False) -> np.ndarray:
        a, b = self.gold.columns[name], self.field(name)
        if lower:
            a, b = pc.utf8_lower(a), pc.utf8_lower(b)
        return pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)

    def flags(self) -> dict[str, np.ndarray]:
        g_root, s_root = self.gold.is_root(), self.system.is_root()
        gb, ge = self.gold.head_spans()
        sb, se = self.system.head_spans()
        if len(s_root):
            s_root, sb, se = s_root[self.to], sb[self.to], se[self.to]
        else:
            s_root, sb, se = np.zeros(len(g_root), bool), np.full(len(gb), -1), np.full(len(gb), -2)
        there = (ge >= gb) & (se >= sb)
        meet = there & ((gb >= sb) & (ge <= se) | (gb <= sb) & (ge >= se))
        root = self.same & g_root & s_root
        uas = root | self.same & ~g_root & ~s_root & meet
        pos, las = self.equal("pos"), uas & self.equal("dep", True)
        return {"tokens": self.same, "tag": self.equal("tag"), "pos": pos, "uas": uas, "las": las, "pos_uas": pos & uas, "pos_las": pos & las, "root": root}

    def entities(self) -> tuple[pa.Array, pa.Array, int]:
        """Labels of the gold entities, those of the system's of the same span (null if there is none), and how many it has."""
        g, s = self.gold, self.system
        gb, gl, g_row = g.entities()
        sb, sl, s_row = s.entities()
        key, own = s_row << 32 | s.first[sb], g_row << 32 | g.first[gb]
        to = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
        found = (key[to] == own) & (s.last[sl][to] == g.last[gl]) if len(key) else np.zeros(len(own), bool)
        label = s.columns["ent_type"].take(pa.array(sb)).take(pa.array(to, pa.int64(), mask=~found))
        return g.columns["ent_type"].take(pa.array(gb)), label, len(sb)


def _counted(batch_pairs: Aligned) -> dict[str, int]:
    g, s = batch_pairs.gold, batch_pairs.system
    flags = batch_pairs.flags()
    out = {k: int(v.sum()) for k, v in flags.items()}
    some = g.size > 0
    for name, k in (("sentence", "tokens"), ("sentence_uas", "uas"), ("sentence_las", "las")):
        out[name] = int((np.bincount(g.row, flags[k], len(g.size))[some] == g.size[some]).sum())
    labels, found, se = batch_pairs.entities()
    right = pc.fill_null(pc.equal(labels, found), False)
    out |= {"n": len(g.row), "roots": int(g.is_root().sum()), "sentences": int(some.sum()), "sn": len(s.row), "sroots": int(s.is_root().sum()), "ssentences": int((s.size > 0).sum())}
    return out | {"ge": len(labels), "se": se, "ent_span": len(found) - found.null_count, "ent_label": int(pc.sum(right).as_py() or 0)}


def _sums(pairs: DataFrame) -> DataFrame:
    """One row with all counters."""
    return _added(pairs.select("gold", "system").mapInArrow(lambda batches: map(sums, batches), SUMS_SCHEMA))


SUMS_SCHEMA = ", ".join(f"{k} bigint" for k in _SUMS)


def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row with the counters of a batch of pairs."""
    c = _counted(Aligned(Side(batch.column("gold")), Side(batch.column("system"))))
    return pa.RecordBatch.from_arrays([pa.array([c[k]], pa.int64()) for k in _SUMS], list(_SUMS))


def _added(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in _SUMS])


def slimmed(tokens: pa.ListArray) -> pa.ListArray:
    """Tokens with the fields that evaluation looks at."""
    flat = pa.StructArray.from_arrays([field(tokens, n) for n in FIELDS], FIELDS)
    return pa.ListArray.from_arrays(pa.array(starts(tokens).astype(np.int32)), flat)


def counts(pairs: DataFrame) -> DataFrame:
    """measure, correct, gold, system."""
    return measures(_sums(pairs))


def measures(sums_: DataFrame) -> DataFrame:
    """measure, correct, gold, system of counters."""
    rows = []
    for m in MEASURES:
        g, s = _TOTALS.get(m, ("n", "sn"))
        rows.append(F.struct(F.lit(m).alias("measure"), F.col(m).alias("correct"), F.col(g).alias("gold"), F.col(s).alias("system")))
    return _added(sums_).select(F.inline(F.array(*rows)))


def rates(counted: DataFrame) -> DataFrame:
    """counts with precision, recall and f1; a rate of nothing is 0."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    p, r = share("correct", "system"), share("correct", "gold")
    return counted.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def composite_score(counted: DataFrame) -> DataFrame:
    """One row: the sum of all counters of agreement."""
    return counted.agg(F.sum("correct").alias("score"))


def _matrix(pairs: DataFrame, labels) -> DataFrame:
    """gold, system, n; labels gives the two label columns of a batch. They are counted in the kernel first."""

    step = matrix_step(labels)
    return added_matrix(pairs.select("gold", "system").mapInArrow(lambda batches: map(step, batches), MATRIX_SCHEMA))


MATRIX_SCHEMA = "gold string, system string, n bigint"


def matrix_step(labels) -> Step:
    """gold, system, n of a batch of pairs."""
    count = counted("gold", "system")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, s = labels(Aligned(Side(batch.column("gold")), Side(batch.column("system"))))
        return count(pa.RecordBatch.from_arrays([g, s], ["gold", "system"]))

    return step


def added_matrix(rows: DataFrame) -> DataFrame:
    return rows.filter("system is not null").groupBy("gold", "system").agg(F.sum("n").alias("n"))


def confusion(pairs: DataFrame, field: str) -> DataFrame:
    """gold, system, n for "pos" or "dep". A gold token that the system missed counts as `_` if no system token ends where it does;
    a relation counts as itself only where the head agrees."""
    return _matrix(pairs, answers(field))


def answers(field: str):
    """The two label columns of `confusion`."""

    def labels(a: Aligned) -> tuple[pa.Array, pa.Array]:
        g, s = a.gold.columns[field], a.field(field)
        if field == "dep":
            g, s = pc.utf8_lower(g), pc.if_else(pa.array(a.flags()["uas"]), s, pc.if_else(pa.array(a.same), MISSED, pa.scalar(None, pa.string())))
        return g, pc.if_else(pa.array(a.ends), s, MISSED)

    return labels


def label_rates(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1 of a confusion matrix; columns are summed without case."""
    right = F.when(F.lower("gold") == F.lower("system"), F.col("n")).otherwise(0)
    both = F.inline(F.array(F.struct(F.lower("gold").alias("label"), right.alias("correct"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("system")), F.struct(F.lower("system").alias("label"), F.lit(0).cast("bigint").alias("correct"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("system"))))
    summed = matrix.select(both).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("correct", "gold", "system")])
    return rates(summed.filter("gold > 0"))


def with_spans(sentences: DataFrame) -> DataFrame:
    """sentences with `spans`, where each token begins and ends in the sentence."""
    place = sentences.columns.index("tokens")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Side(batch.column(place))
            spans = pa.StructArray.from_arrays([pa.array(t.first.astype(np.int32)), pa.array(t.last.astype(np.int32))], ["begin", "end"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(t.begin.astype(np.int32)), spans)], [*batch.schema.names, "spans"])

    kind = _parse_datatype_string("array<struct<begin:int,end:int>>")
    return sentences.mapInArrow(stage, StructType([*sentences.schema.fields, StructField("spans", kind)]))


def with_entities(sentences: DataFrame) -> DataFrame:
    """sentences with `entities`: begin, end (characters) and label of each."""
    place = sentences.columns.index("tokens")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Side(batch.column(place))
            first, last, row = t.entities()
            found = pa.StructArray.from_arrays([pa.array(t.first[first].astype(np.int32)), pa.array(t.last[last].astype(np.int32)), t.columns["ent_type"].take(pa.array(first))], ["begin", "end", "label"])
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), found)], [*batch.schema.names, "entities"])

    kind = _parse_datatype_string("array<struct<begin:int,end:int,label:string>>")
    return sentences.mapInArrow(stage, StructType([*sentences.schema.fields, StructField("entities", kind)]))


def entities(sentences: DataFrame) -> DataFrame:
    """sent, begin, end (characters), label of the entities of sentences (sent, tokens)."""
    return with_entities(sentences.select("sent", "tokens")).select("sent", F.inline("entities"))


def entity_counts(pairs: DataFrame) -> DataFrame:
    return entity_totals(_sums(pairs))


def entity_totals(sums_: DataFrame) -> DataFrame:
    return _added(sums_).select("ge", "se", "ent_span", "ent_label")


def entity_confusion(pairs: DataFrame) -> DataFrame:
    """gold, system, n over the entities of gold."""
    return _matrix(pairs, entity_answers)


def entity_answers(a: Aligned) -> tuple[pa.Array, pa.Array]:
    g, s, _ = a.entities()
    return g, pc.fill_null(s, MISSED)


def aligned(pairs: DataFrame) -> DataFrame:
    """A row for each gold token: sent, begin, end, its fields (g), those of the system token of the same span (s, null if none), and
    whether some system token ends where it does."""
    kind = _parse_datatype_string(f"begin int, end int, {BOTH}")
    schema = StructType([pairs.schema["sent"], *kind.fields, StructField("ends", BooleanType())])
    return pairs.select("sent", "gold", "system").mapInArrow(lambda batches: map(aligned_rows, batches), schema)


BOTH = "g struct<tag:string,pos:string,dep:string>, s struct<tag:string,pos:string,dep:string>"


def aligned_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What aligned returns, of a batch of pairs."""
    names = ("tag", "pos", "dep")
    a = Aligned(Side(batch.column("gold")), Side(batch.column("system")))
    g = pa.StructArray.from_arrays([a.gold.columns[n] for n in names], names)
    s = pa.StructArray.from_arrays([a.field(n) for n in names], names, mask=pa.array(~a.same))
    return pa.RecordBatch.from_arrays([batch.column("sent").take(pa.array(a.gold.row)), pa.array(a.gold.first.astype(np.int32)), pa.array(a.gold.last.astype(np.int32)), g, s, pa.array(a.ends)], ["sent", "begin", "end", "g", "s", "ends"])


def conditional_accuracy(pairs: DataFrame, condition: Column) -> DataFrame:
    """Agreement of the part of speech among matched tokens for which a condition on the gold fields g.* holds: n, correct, accuracy."""
    return accuracy(aligned(pairs), condition)


def accuracy(rows: DataFrame, condition: Column) -> DataFrame:
    both = rows.filter(F.col("s").isNotNull() & condition)
    n, right = F.count(F.lit(1)), F.sum(F.when(F.col("g.pos") == F.col("s.pos"), 1).otherwise(0))
    return both.agg(n.alias("n"), F.coalesce(right, F.lit(0)).alias("correct")).withColumn("accuracy", F.when(F.col("n") > 0, F.col("correct") / F.col("n")).otherwise(0.0))


#: Stretches of equal width into which a key's values are counted first.
STRETCHES = 4096


def upper_median(times: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper median of a number by keys, nulls aside. Values are counted by stretches of their range first; only those of the
    stretch that holds the median are then counted one by one, so no key's values are gathered."""
    v = F.col(value)
    known = times.filter(v.isNotNull())
    range_ = known.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"), (F.floor(F.count(F.lit(1)) / 2) + 1).alias("place"))

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"__{k}") for k in on], *[c for c in right.columns if c not in on])
        same = F.lit(True)
        for k in on:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return left.join(r, same).drop(*[f"__{k}" for k in on])

    width = F.col("high").cast("double") - F.col("low").cast("double")
    stretch = F.when(width > 0, F.least(F.floor((v.cast("double") - F.col("low").cast("double")) / width * STRETCHES), F.lit(STRETCHES - 1))).otherwise(0).cast("int")
    counted = joined(known.select(*keys, v), range_, keys).groupBy(*keys, F.col("place"), stretch.alias("stretch"), v).agg(F.count(F.lit(1)).alias("n"))
    stretches = counted.groupBy(*keys, "place", "stretch").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0))
    chosen = stretches.withColumn("upto", upto).filter("place <= upto and place > upto - n").select(*keys, "stretch", (F.col("place") - (F.col("upto") - F.col("n"))).alias("rest"))
    inner = F.sum("n").over(Window.partitionBy(*keys).orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
    within = joined(counted, chosen, [*keys, "stretch"]).withColumn("inner", inner)
    return within.filter("rest <= inner and rest > inner - n").select(*keys, v.alias("median"))


def report(rated: DataFrame) -> DataFrame:
    """One line of text a measure."""
    return rated.select(F.format_string("%-13s correct %d of %d gold, %d system; precision %.4f recall %.4f f1 %.4f", "measure", "correct", "gold", "system", "precision", "recall", "f1").alias("line"))
