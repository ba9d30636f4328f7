"""Spans, phrases and frames of recognised sentences, as array expressions on the sentence's own row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.flow import counted, field, ints, joined as joined_stretches, joined_ranges, owners, per_row, starts, with_column
from .recognize import flatten
from .tokens import at, joined, traverse

Field = Callable[[Column], Column]


def orth(token: Column) -> Column:
    return token["orth"]


def lemma(token: Column) -> Column:
    return token["lemma"]


def available(df: DataFrame) -> bool:
    """Whether sentences have been recognised."""
    return "units" in df.columns


def head_places(units: Column) -> Column:
    return F.filter(F.transform(units, lambda u, k: F.when(u["is_head"], k)), lambda k: k.isNotNull())


def spans(units: Column) -> Column:
    """The bunsetu of a sentence: start, end, root, label, phrase_start, phrase_end."""
    firsts = F.filter(units, lambda u: u["bi"] == "B")
    return F.transform(
        firsts,
        lambda u: F.struct(u["start"], u["end"], u["bunsetu_root"].alias("root"), u["label"], u["phrase_start"], u["phrase_end"]),
    )


def words(tokens: Column, start: Column, end: Column) -> Column:
    return F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0)))


def bunsetu(tokens: Column, unit: Column, func: Field = orth, condition: Field | None = None, join: Callable[[Column], Column] = joined) -> Column:
    """The bunsetu of a token, joined."""
    return traverse(words(tokens, unit["start"], unit["end"]), func, condition, join)


def phrase(tokens: Column, unit: Column, func: Field = orth, condition: Field | None = None, join: Callable[[Column], Column] = joined) -> Column:
    """The phrase of a token's bunsetu, joined."""
    return traverse(words(tokens, unit["phrase_start"], unit["phrase_end"]), func, condition, join)


def bunsetu_table(recognised: DataFrame, func: Field = orth) -> DataFrame:
    """A row a bunsetu: doc_id, sent_id, start, end, root, label, bunsetu, phrase."""
    tokens = F.col("tokens")

    def row(s: Column) -> Column:
        return F.struct(
            s["start"],
            s["end"],
            s["root"],
            s["label"],
            traverse(words(tokens, s["start"], s["end"]), func).alias("bunsetu"),
            traverse(words(tokens, s["phrase_start"], s["phrase_end"]), func).alias("phrase"),
            s["phrase_start"],
            s["phrase_end"],
        )

    return recognised.select("doc_id", "sent_id", F.inline(F.transform(spans(F.col("units")), row)))


def sub_phrase_array(func: Field = lemma, condition: Field | None = None) -> Column:
    """The bunsetu heads below a bunsetu's root, of a sentence: parent (place), i, dep, phrase of the head, head_phrase of the parent,
    head_pos."""
    tokens, units = F.col("tokens"), F.col("units")

    def wanted(x: Column) -> Column:
        up = x["t"]["head"]
        good = x["u"]["is_head"] & (up != x["i"]) & (at(units, up)["bunsetu_root"] == up)
        return good & condition(x["t"]) if condition else good

    def row(x: Column) -> Column:
        up = x["t"]["head"]
        return F.struct(
            up.alias("parent"),
            x["i"].alias("i"),
            x["t"]["dep"].alias("dep"),
            phrase(tokens, x["u"], func).alias("phrase"),
            phrase(tokens, at(units, up), func).alias("head_phrase"),
            at(tokens, up)["pos"].alias("head_pos"),
        )

    each = F.transform(F.arrays_zip("tokens", "units"), lambda x, i: F.struct(i.alias("i"), x["tokens"].alias("t"), x["units"].alias("u")))
    return F.transform(F.filter(each, wanted), row)


def sub_phrases(recognised: DataFrame, func: Field = lemma, condition: Field | None = None) -> DataFrame:
    """A row for each bunsetu head below a bunsetu's root: doc_id, sent_id, parent (place), i, dep, phrase of the head, head_phrase of the
    parent, head_pos. It is found within the sentence's row, whose arrays aren't copied."""
    return recognised.select("doc_id", "sent_id", F.inline(sub_phrase_array(func, condition)))


def frames(recognised: DataFrame, roles: tuple[str, ...] = ("nsubj", "obj"), head_pos: str = "VERB", distinct_sentences: bool = True) -> DataFrame:
    """How often a head goes with one phrase in each role: columns named by the roles, head, frequency. Sentences of the same text
    count once. Only the frames of a sentence move, not the sentence."""
    parts = F.filter(sub_phrase_array(), lambda p: (p["head_pos"] == head_pos) & p["dep"].isin(*roles))
    rows = recognised.select(F.unhex(F.md5("text")).alias("key"), parts.alias("parts")).filter(F.size("parts") >= len(roles))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(sentence_frames(roles), batches)

    return frame_counts(rows.mapInArrow(stage, frames_schema(roles)), roles, distinct_sentences)


def frames_schema(roles: tuple[str, ...]) -> str:
    return f"key binary, found array<struct<{', '.join(f'r{k}:string' for k in range(len(roles)))},head:string>>"


def keyed_parts(roles: tuple[str, ...], head_pos: str = "VERB") -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A row a sentence with parts of frames: key (of its text), parts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), *batch.columns[1:]], batch.schema.names)
        rows = sub_phrase_rows(ids)
        rows = rows.filter(pc.and_(pc.equal(rows.column("head_pos"), head_pos), pc.is_in(rows.column("dep"), pa.array(roles))))
        some, first, size = np.unique(rows.column(0).to_numpy(), return_index=True, return_counts=True)
        parts = pa.ListArray.from_arrays(ints(np.append(first, rows.num_rows)), pa.StructArray.from_arrays(rows.columns[2:], rows.schema.names[2:]))
        keys = [hashlib.md5(t.encode()).digest() for t in batch.column("text").take(pa.array(some)).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), parts], ["key", "parts"]).filter(pa.array(size >= len(roles)))

    return step


def sentence_frames(roles: tuple[str, ...]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The frames of sentences (key, parts)."""
    names = [f"r{k}" for k in range(len(roles))]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        flat = lists.flatten()
        parent, dep, phrases_, head = (flat.field(flat.type.get_field_index(n)) for n in ("parent", "dep", "phrase", "head_phrase"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        key = row.astype(np.int64) << 32 | parent.to_numpy(zero_copy_only=False).astype(np.int64)
        whole, places = None, []
        for role in roles:  # the first of each role, as parts come by place
            mine = np.flatnonzero(pc.equal(dep, role).to_numpy(zero_copy_only=False))
            keys, first = np.unique(key[mine], return_index=True)
            places.append((keys, mine[first]))
            whole = keys if whole is None else np.intersect1d(whole, keys, assume_unique=True)
        chosen = [places_[np.searchsorted(keys, whole)] for keys, places_ in places]
        values = [phrases_.take(pa.array(c)) for c in chosen] + [head.take(pa.array(chosen[0]))]
        some, first = np.unique(whole >> 32, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(whole)).astype(np.int32)), pa.StructArray.from_arrays(values, [*names, "head"]))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists], ["key", "found"])

    return step


def frame_counts(found: DataFrame, roles: tuple[str, ...], distinct_sentences: bool = True) -> DataFrame:
    """How often frames are in sentences (key, found)."""
    names = [f"r{k}" for k in range(len(roles))]
    if distinct_sentences:
        found = found.dropDuplicates(["key"])
    named = [F.col(n).alias(r) for n, r in zip(names, roles, strict=True)]
    return found.select(F.inline("found")).groupBy(*named, "head").agg(F.count(F.lit(1)).alias("frequency"))


def clauses(recognised: DataFrame, func: Field = orth) -> DataFrame:
    """A row a clause: doc_id, sent_id, clause (place of its head), places, text."""
    rows = recognised.select("doc_id", "sent_id", F.transform("tokens", func).alias("words"), F.col("units.clause").alias("of"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(clause_rows, batches)

    return rows.mapInArrow(stage, "doc_id bigint, sent_id int, clause int, places array<int>, text string")


def words_and_clauses(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, sent_id, words, clause heads of a batch of recognised sentences."""
    tokens, units = batch.column("tokens"), batch.column("units")
    lists = [pa.ListArray.from_arrays(ints(starts(x)), field(x, n)) for x, n in ((tokens, "orth"), (units, "clause"))]
    return per_row(batch, words=lists[0], of=lists[1])


def clause_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Clauses of sentences (doc_id, sent_id, words, clause heads)."""
    lists = batch.column(3)
    begin = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(begin)
    row = np.repeat(np.arange(batch.num_rows), size)
    clause = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(clause)) - np.repeat(begin[:-1] - begin[0], size)
    at_ = np.flatnonzero(clause >= 0)
    at_ = at_[np.lexsort((at_, clause[at_], row[at_]))]
    new = np.flatnonzero(np.append(True, (row[at_][1:] != row[at_][:-1]) | (clause[at_][1:] != clause[at_][:-1]))) if len(at_) else at_
    ends = pa.array(np.append(new, len(at_)).astype(np.int32))
    texts = pc.binary_join(pa.ListArray.from_arrays(ends, batch.column(2).flatten().take(pa.array(at_))), " ")
    first = at_[new]
    ids = [batch.column(k).take(pa.array(row[first])) for k in (0, 1)]
    places = pa.ListArray.from_arrays(ends, pa.array(place[at_].astype(np.int32)))
    return pa.RecordBatch.from_arrays([*ids, pa.array(clause[first].astype(np.int32)), places, texts], ["doc_id", "sent_id", "clause", "places", "text"])

def _places(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return field(batch.column("units"), name).to_numpy(zero_copy_only=False).astype(np.int64)


def _flags(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, False).to_numpy(zero_copy_only=False)


def phrase_lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row a bunsetu head: the label of its phrase and the number of its words."""
    units = batch.column("units")
    at = pc.filter(pa.StructArray.from_arrays([field(units, n) for n in ("label", "phrase_start", "phrase_end")], ["label", "start", "end"]), field(units, "is_head"))
    return pa.RecordBatch.from_arrays([at.field("label"), pc.subtract(at.field("end"), at.field("start"))], ["label", "n_words"])


#: Steps that count phrases by label and length.
span_counts = (phrase_lengths, counted("label", "n_words"))


def bunsetu_heads(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row a sentence: the places of its bunsetu heads."""
    units = batch.column("units")
    begin, row = starts(units), owners(units)
    at_ = np.flatnonzero(_flags(field(units, "is_head")))
    return per_row(batch, heads=joined_stretches(ints(at_ - begin[:-1][row[at_]]), np.searchsorted(row[at_], np.arange(batch.num_rows + 1)), " "))


def _bunsetu(batch: pa.RecordBatch, words_: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where bunsetu begin, the bunsetu of each token, and the joined phrases of the bunsetu."""
    first = np.flatnonzero(_flags(pc.equal(field(batch.column("units"), "bi"), "B")))
    begin = starts(batch.column("units"))[:-1][owners(batch.column("units"))[first]]
    phrases_ = joined_ranges(words_, _places(batch, "phrase_start")[first] + begin, _places(batch, "phrase_end")[first] + begin, "+")
    return first, np.searchsorted(first, np.arange(len(words_)), side="right") - 1, phrases_


def bunsetu_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What bunsetu_table returns, with surfaces."""
    words_ = field(batch.column("tokens"), "orth")
    first, _, phrases_ = _bunsetu(batch, words_)
    at_ = pa.array(first)
    of = {n: field(batch.column("units"), n).take(at_) for n in ("start", "end", "bunsetu_root", "label", "phrase_start", "phrase_end")}
    texts = joined_stretches(words_, np.append(first, len(words_)), "+")
    row = owners(batch.column("units"))[first]
    return per_row(batch, row, start=of["start"], end=of["end"], root=of["bunsetu_root"], label=of["label"], bunsetu=texts, phrase=phrases_, phrase_start=of["phrase_start"], phrase_end=of["phrase_end"])


def sub_phrase_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What sub_phrases returns, with lemmas."""
    tokens = batch.column("tokens")
    f, row = flatten(tokens), owners(tokens)
    _, of, phrases_ = _bunsetu(batch, f.strings("lemma"))
    root = _places(batch, "bunsetu_root") + f.begin[:-1][row]
    at_ = np.flatnonzero(_flags(field(batch.column("units"), "is_head")) & (f.head != np.arange(len(row))) & (root[f.head] == f.head)) if len(row) else row
    up, begin = f.head[at_], f.begin[:-1][row[at_]]
    return per_row(
        batch, row[at_], parent=ints(up - begin), i=ints(at_ - begin), dep=f.strings("dep").take(pa.array(at_)), phrase=phrases_.take(pa.array(of[at_])),
        head_phrase=phrases_.take(pa.array(of[up])), head_pos=f.strings("pos").take(pa.array(up)),
    )


def with_bunsetu(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of recognised sentences with `spans`: start and end of its bunsetu."""
    units = batch.column("units")
    first = np.flatnonzero(_flags(pc.equal(field(units, "bi"), "B")))
    found = pa.StructArray.from_arrays([field(units, n).take(pa.array(first)) for n in ("start", "end")], ["start", "end"])
    return with_column(batch, "spans", pa.ListArray.from_arrays(ints(np.searchsorted(first, starts(units))), found))
