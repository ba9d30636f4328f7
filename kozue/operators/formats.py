"""Text formats of sentences, each one expression on the sentence's row: no shuffle and no Python.

Values are escaped only where the format has an escape. `sentence` columns are doc_id, sent_id, text, tokens and, if recognised,
units; the result is doc_id, sent_id, and `out`, the sentence's lines.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import OTHERS, ent_label_ene, ent_label_ontonotes, inflection_form, label_rows, reading_form
from ..plans.flow import Step, field, joined, owners, per_row, starts

FORMATS = {"0": "conllu", "1": "cabocha", "2": "mecab", "3": "json"}


def format_name(choice: str | int) -> str:
    name = FORMATS.get(str(choice), str(choice))
    if name not in FORMATS.values():
        raise ValueError(f"there is no output format {choice}")
    return name


def _unless_empty(prefix: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(prefix), value))


def _misc(t: Column, u: Column | None, i: Column, use_orth: bool) -> Column:
    reading = F.coalesce(reading_form(t["reading"], t["orth"] if use_orth else None), F.lit(""))
    escaped = F.replace(F.replace(reading, F.lit("|"), F.lit("\\|")), F.lit("\\"), F.lit("\\\\"))
    ene, coarse = ent_label_ene(t["ent_iob"], t["ent_type"]), ent_label_ontonotes(t["ent_iob"], t["ent_type"])
    fields = [F.when(F.coalesce(t["ws"], F.lit("")) != "", "SpaceAfter=Yes").otherwise("SpaceAfter=No")]
    if u is not None:
        inside = (u["label"] == "NP") & (i >= u["phrase_start"]) & (i < u["phrase_end"])
        fields += [
            F.concat(F.lit("BunsetuBILabel="), u["bi"]),
            F.concat(F.lit("BunsetuPositionType="), u["position"]),
            F.when(inside, F.when(i == u["phrase_start"], "NP_B").otherwise("NP_I")),
        ]
    fields += [
        _unless_empty("Inf=", inflection_form(t["inflection"])),
        _unless_empty("Reading=", escaped),
        F.when(coarse != "O", F.concat(F.lit("NE="), coarse)),
        F.when(ene != "O", F.concat(F.lit("ENE="), ene)),
    ]
    if u is not None:
        fields.append(F.when(u["clause"] >= 0, F.concat(F.lit("ClauseHead="), (u["clause"] + 1).cast("string"))))
    return F.concat_ws("|", *fields)


def _each(df: DataFrame, line) -> Column:
    if "units" in df.columns:
        return F.transform(F.arrays_zip("tokens", "units"), lambda x, i: line(x["tokens"], x["units"], i))
    return F.transform("tokens", lambda t, i: line(t, None, i))


def conllu(df: DataFrame, normalized: bool = False, use_orth: bool = False, origin: bool = True) -> Column:
    def line(t: Column, u: Column | None, i: Column) -> Column:
        tag = F.replace(F.replace(t["tag"], F.lit(",*"), F.lit("")), F.lit(","), F.lit("-"))
        return F.concat(
            F.concat_ws(
                "\t",
                (i + 1).cast("string"),
                t["orth"],
                t["norm"] if normalized else t["lemma"],
                t["pos"],
                tag,
                F.when(t["pos"] == "NUM", "NumType=Card").otherwise("_"),
                F.when(t["head"] == i, "0").otherwise((t["head"] + 1).cast("string")),
                F.when(t["dep"] != "", F.lower(t["dep"])).otherwise("_"),
                F.lit("_"),
                _misc(t, u, i, use_orth),
            ),
            F.lit("\n"),
        )

    lines = F.concat(F.array_join(_each(df, line), ""), F.lit("\n"))
    return F.concat(F.lit("# text = "), F.coalesce("text", F.lit("")), F.lit("\n"), lines) if origin else lines


def _entity(t: Column) -> Column:
    return F.when(t["ent_iob"] == "O", "O").otherwise(F.concat(t["ent_iob"], F.lit("-"), F.coalesce(t["ent_type"], F.lit(""))))


def cabocha(df: DataFrame, normalized: bool = False) -> Column:
    if "units" not in df.columns:
        raise ValueError("this format needs recognised sentences")

    def line(t: Column, u: Column, i: Column) -> Column:
        tag = F.replace(t["tag"], F.lit("-"), F.lit(","))
        commas = F.length(tag) - F.length(F.replace(tag, F.lit(",")))
        inflection = inflection_form(t["inflection"])
        reading = reading_form(t["reading"], t["orth"])
        token = F.concat(
            t["orth"], F.lit("\t"), tag, F.repeat(F.lit(",*"), F.greatest(F.lit(3) - commas, F.lit(0))), F.lit(","),
            F.when(inflection != "", inflection).otherwise("*,*"), F.lit(","), t["norm"] if normalized else t["lemma"], F.lit(","),
            F.when(reading != "", reading).otherwise(t["orth"]), F.lit(",*\t"), _entity(t), F.lit("\n"),
        )
        header = F.concat(
            F.lit("* "), u["bunsetu"].cast("string"), F.lit(" "), u["link_bunsetu"].cast("string"), F.lit("D "),
            u["link_offset"].cast("string"), F.lit("/"), u["func_offset"].cast("string"), F.lit(" 0.000000\n"),
        )
        return F.when(u["bi"] == "B", F.concat(header, token)).otherwise(token)

    return F.concat(F.array_join(_each(df, line), ""), F.lit("EOS\n\n"))


def mecab(df: DataFrame, normalized: bool = False) -> Column:
    """Morphemes only; the tag's parts are padded to six fields."""

    def line(t: Column, _u: Column | None, _i: Column) -> Column:
        tag = F.replace(t["tag"], F.lit("-"), F.lit(","))
        commas = F.length(tag) - F.length(F.replace(tag, F.lit(",")))
        reading = F.coalesce(t["reading"], F.lit(""))
        return F.concat(
            t["orth"], F.lit("\t"), tag, F.repeat(F.lit(",*"), F.greatest(F.lit(5) - commas, F.lit(0))), F.lit(","),
            t["norm"] if normalized else t["lemma"], F.lit(","), F.when(reading != "", reading).otherwise(t["orth"]), F.lit(",*\n"),
        )

    return F.concat(F.array_join(_each(df, line), ""), F.lit("EOS\n\n"))


def gold_tokens(tokens: str = "tokens") -> Column:
    """Tokens as the JSON format has them: ids from 1, heads relative."""
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            (i + 1).alias("id"),
            t["orth"].alias("orth"),
            t["tag"].alias("tag"),
            t["pos"].alias("pos"),
            t["lemma"].alias("lemma"),
            t["norm"].alias("norm"),
            (t["head"] - i).alias("head"),
            t["dep"].alias("dep"),
            F.concat(t["ent_iob"], F.when(F.coalesce(t["ent_type"], F.lit("")) != "", F.concat(F.lit("-"), t["ent_type"])).otherwise("")).alias("ner"),
            F.when(F.coalesce(t["ws"], F.lit("")) != "", t["ws"]).alias("whitespace"),
        ),
    )


def json_sentence(df: DataFrame) -> Column:
    sentence = F.struct(gold_tokens().alias("tokens"))
    return F.to_json(F.struct(F.array(F.struct(F.col("text").alias("raw"), F.array(sentence).alias("sentences"))).alias("paragraphs")))


def formatted(df: DataFrame, choice: str | int = "conllu", normalized: bool = False, use_orth: bool = False, origin: bool = True) -> DataFrame:
    name = format_name(choice)
    out = {
        "conllu": lambda: conllu(df, normalized, use_orth, origin),
        "cabocha": lambda: cabocha(df, normalized),
        "mecab": lambda: mecab(df, normalized),
        "json": lambda: json_sentence(df),
    }[name]()
    return df.select("doc_id", "sent_id", out.alias("out"))


# The same over batches of sentences, for flows: values of all tokens at once.


def _concat(*parts: pa.Array | str) -> pa.Array:
    """Strings element by element; null where one of them is."""
    return pc.binary_join_element_wise(*parts, "")


def _text(values) -> pa.Array:
    return (pa.array(values) if isinstance(values, np.ndarray) else values).cast(pa.string())


def _each_word(values: pa.Array, f) -> pa.Array:
    """f of strings, once for each different one."""
    coded = values.dictionary_encode()
    return pa.array([None if x is None else f(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


class _Words:
    """Tokens and units of a batch by name, and their places."""

    def __init__(self, batch: pa.RecordBatch):
        tokens = batch.column("tokens")
        self.batch, self.begin, row = batch, starts(tokens), owners(tokens)
        self.i = np.arange(len(row)) - self.begin[:-1][row]
        self.head = field(tokens, "head").to_numpy(zero_copy_only=False).astype(np.int64)

    def __getitem__(self, name: str) -> pa.Array:
        return field(self.batch.column("tokens"), name)

    def unit(self, name: str) -> pa.Array:
        return field(self.batch.column("units"), name)

    def numbers(self, name: str) -> np.ndarray:
        return self.unit(name).to_numpy(zero_copy_only=False).astype(np.int64)

    def out(self, lines: pa.Array, before: pa.Array | str, after: str) -> pa.RecordBatch:
        return per_row(self.batch, out=_concat(before, joined(lines, self.begin, ""), after))

    def labelled(self, kind: pa.Array) -> pa.Array:
        """Labels of tokens in entities, null of others."""
        return pc.if_else(pc.is_in(self["ent_iob"], pa.array(["B", "I"])), _concat(self["ent_iob"], "-", kind), pa.scalar(None, pa.string()))

    def inflection(self) -> pa.Array:
        return pc.replace_substring(pc.fill_null(self["inflection"], ""), ";", ",")


def _given(prefix: str, value: pa.Array) -> pa.Array:
    return pc.if_else(pc.not_equal(value, ""), _concat(prefix, value), pa.scalar(None, pa.string()))


def _spaced(ws: pa.Array) -> pa.Array:
    return pc.not_equal(pc.fill_null(ws, ""), "")


def conllu_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, sent_id, out of a batch of recognised sentences."""
    w, none = _Words(batch), pa.scalar(None, pa.string())
    coarse = {a: b for a, b, _ in label_rows()}
    kind = pc.fill_null(w["ent_type"], "")
    start, end, clause = (w.numbers(n) for n in ("phrase_start", "phrase_end", "clause"))
    inside = pc.and_(pc.equal(w.unit("label"), "NP"), pa.array((w.i >= start) & (w.i < end)))
    misc = pc.binary_join_element_wise(
        pc.if_else(_spaced(w["ws"]), "SpaceAfter=Yes", "SpaceAfter=No"),
        _concat("BunsetuBILabel=", w.unit("bi")),
        _concat("BunsetuPositionType=", w.unit("position")),
        pc.if_else(inside, pc.if_else(pa.array(w.i == start), "NP_B", "NP_I"), none),
        _given("Inf=", w.inflection()),
        _given("Reading=", pc.replace_substring(pc.replace_substring(pc.fill_null(w["reading"], ""), "|", "\\|"), "\\", "\\\\")),
        _concat("NE=", w.labelled(_each_word(kind, lambda x: coarse.get(x) or OTHERS))),
        _concat("ENE=", w.labelled(kind)),
        pc.if_else(pa.array(clause >= 0), _concat("ClauseHead=", _text(clause + 1)), none),
        "|", null_handling="skip",
    )
    lines = pc.binary_join_element_wise(
        _text(w.i + 1), w["orth"], w["lemma"], w["pos"], _each_word(w["tag"], lambda x: x.replace(",*", "").replace(",", "-")),
        pc.if_else(pc.equal(w["pos"], "NUM"), "NumType=Card", "_"), _text(np.where(w.head == w.i, 0, w.head + 1)),
        _each_word(w["dep"], lambda x: x.lower() or "_"), "_", misc, "\t", null_handling="skip",
    )
    return w.out(_concat(lines, "\n"), _concat("# text = ", pc.fill_null(batch.column("text"), ""), "\n"), "\n")


def cabocha_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, sent_id, out of a batch of recognised sentences."""
    w = _Words(batch)
    inflection = w.inflection()
    header = _concat("* ", _text(w.unit("bunsetu")), " ", _text(w.unit("link_bunsetu")), "D ", _text(w.unit("link_offset")), "/", _text(w.unit("func_offset")), " 0.000000\n")
    entity = pc.if_else(pc.equal(w["ent_iob"], "O"), "O", _concat(w["ent_iob"], "-", pc.fill_null(w["ent_type"], "")))
    token = _concat(_morpheme(w, 3, pc.if_else(pc.not_equal(inflection, ""), inflection, "*,*"), w["lemma"]), ",*\t", entity, "\n")
    return w.out(pc.if_else(pc.equal(w.unit("bi"), "B"), _concat(header, token), token), "", "EOS\n\n")


def _morpheme(w: _Words, stars: int, inflection: pa.Array | None, lemma: pa.Array) -> pa.Array:
    def padded(tag: str) -> str:
        return (t := tag.replace("-", ",")) + ",*" * max(0, stars - t.count(","))

    reading = pc.coalesce(w["reading"], w["orth"] if stars == 3 else pa.scalar(""))
    reading = pc.if_else(pc.not_equal(reading, ""), reading, w["orth"])
    return _concat(w["orth"], "\t", _each_word(w["tag"], padded), ",", *([inflection, ","] if inflection is not None else []), lemma, ",", reading)


def mecab_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, sent_id, out of a batch of sentences, with normalised forms."""
    w = _Words(batch)
    return w.out(_concat(_morpheme(w, 5, None, w["norm"]), ",*\n"), "", "EOS\n\n")


def _quoted(text: str) -> str:
    """A JSON string as Spark writes it."""
    out = json.dumps(text, ensure_ascii=False)
    return re.sub(r"\\\\|\\u00..", lambda m: m[0][:2] + m[0][2:].upper(), out) if "\\u00" in out else out


def json_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, sent_id, out of a batch of sentences; what is null is left out."""
    w = _Words(batch)
    kind = pc.fill_null(w["ent_type"], "")
    ner = _concat(w["ent_iob"], pc.if_else(pc.not_equal(kind, ""), _concat("-", kind), ""))
    named = [(n, w[n]) for n in ("orth", "tag", "pos", "lemma", "norm")]
    parts = [_each_word(x, lambda v, n=n: f'"{n}":{_quoted(v)}') for n, x in named]
    parts += [_concat('"head":', _text(w.head - w.i)), _concat('"dep":', _each_word(w["dep"], _quoted)), _concat('"ner":', _each_word(ner, _quoted))]
    parts.append(pc.if_else(_spaced(w["ws"]), _concat('"whitespace":', _each_word(w["ws"], _quoted)), pa.scalar(None, pa.string())))
    each = _concat("{", pc.binary_join_element_wise(_concat('"id":', _text(w.i + 1)), *parts, ",", null_handling="skip"), "}")
    raw = pa.array([None if x is None else f'"raw":{_quoted(x)},' for x in batch.column("text").to_pylist()], pa.string())
    return per_row(batch, out=_concat('{"paragraphs":[{', pc.fill_null(raw, ""), '"sentences":[{"tokens":[', joined(each, w.begin, ","), "]}]}]}"))
