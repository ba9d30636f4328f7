"""Lattice tokenizer: the cheapest path through the dictionary words and unknown runs that cover a line.

A dictionary is a table of entries (surface, tag, lemma, norm, reading, inflection, cost, a, b), where a and b are short and middle
splits by "/"; a user dictionary is more of them. It's small enough to go along with the tasks; larger ones belong to an external
annotator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.split import default_pos, split_sentence
from ..schema import ARROW_TOKEN, SENTENCE, SUBS

UNKNOWN_COST, UNKNOWN_CHAR = 900, 120


@dataclass(frozen=True)
class Entry:
    surface: str
    tag: str
    cost: int = 300
    lemma: str = ""
    norm: str = ""
    reading: str = ""
    inflection: str = ""
    a: str = ""
    b: str = ""


#: Enough for a first sentence; a real dictionary is given by the user.
SMALL = (
    Entry("機能性食品", "名詞-普通名詞-一般", 500, reading="キノウセイショクヒン", a="機能/性/食品", b="機能性/食品"),
    Entry("機能", "名詞-普通名詞-サ変可能", 400, reading="キノウ"),
    Entry("性", "接尾辞-名詞的-一般", 350, reading="セイ"),
    Entry("食品", "名詞-普通名詞-一般", 400, reading="ショクヒン"),
    Entry("銀座", "名詞-固有名詞-地名-一般", reading="ギンザ"),
    Entry("東京", "名詞-固有名詞-地名-一般", reading="トウキョウ"),
    Entry("ランチ", "名詞-普通名詞-一般", reading="ランチ"),
    Entry("一緒", "名詞-普通名詞-サ変可能", reading="イッショ"),
    Entry("今日", "名詞-普通名詞-副詞可能", reading="キョウ"),
    Entry("明日", "名詞-普通名詞-副詞可能", reading="アス"),
    Entry("蕎麦", "名詞-普通名詞-一般", reading="ソバ"),
    Entry("かつ丼", "名詞-普通名詞-一般", reading="カツドン"),
    Entry("食べ", "動詞-一般", lemma="食べる", norm="食べる", reading="タベ", inflection="下一段-バ行;連用形-一般"),
    Entry("食べる", "動詞-一般", 400, reading="タベル", inflection="下一段-バ行;終止形-一般"),
    Entry("し", "動詞-非自立可能", lemma="する", norm="為る", reading="シ", inflection="サ行変格;連用形-一般"),
    Entry("た", "助動詞", reading="タ", inflection="助動詞-タ;終止形-一般"),
    Entry("ましょう", "助動詞", lemma="ます", norm="ます", reading="マショウ", inflection="助動詞-マス;意志推量形"),
    Entry("ご", "接頭辞", norm="御", reading="ゴ"),
    Entry("は", "助詞-係助詞", 150, reading="ハ"),
    Entry("が", "助詞-格助詞", 150, reading="ガ"),
    Entry("で", "助詞-格助詞", 150, reading="デ"),
    Entry("を", "助詞-格助詞", 150, reading="ヲ"),
    Entry("。", "補助記号-句点", 100, reading="。"),
    Entry("、", "補助記号-読点", 100, reading="、"),
)


def _kind(c: str) -> str:
    if c.isspace():
        return "space"
    if c.isdigit():
        return "digit"
    if "ぁ" <= c <= "ゟ":
        return "hiragana"
    if "゠" <= c <= "ヿ":
        return "katakana"
    return "letter" if c.isalnum() else "symbol"


class Lattice:
    def __init__(self, entries: Iterable[Entry]):
        self.trie: dict = {}
        for e in entries:
            node = self.trie
            for c in e.surface:
                node = node.setdefault(c, {})
            if "" not in node or node[""].cost > e.cost:
                node[""] = e
        self.surfaces = {e.surface: e for e in entries}

    def best(self, text: str) -> list[tuple[int, int, Entry | None]]:
        n = len(text)
        kinds = [_kind(c) for c in text]
        run = list(range(n))
        for i in range(n - 1, -1, -1):  # where the run of one kind that begins at i ends
            run[i] = run[i + 1] if i + 1 < n and kinds[i + 1] == kinds[i] and kinds[i] != "symbol" else i + 1
        cost: list[float] = [0.0] + [float("inf")] * n
        back: list = [None] * (n + 1)

        def reach(i: int, j: int, c: float, e: Entry | None) -> None:
            if cost[i] + c < cost[j]:
                cost[j], back[j] = cost[i] + c, (i, e)

        for i in range(n):
            if cost[i] == float("inf"):
                continue
            node, j = self.trie, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    reach(i, j, node[""].cost, node[""])
            # One character at a time, the whole run, or white space, which costs nothing.
            if kinds[i] == "space":
                reach(i, run[i], 0, None)
            else:
                reach(i, run[i], UNKNOWN_COST + UNKNOWN_CHAR * (run[i] - i), None)
                reach(i, i + 1, UNKNOWN_COST + UNKNOWN_CHAR, None)
        path, j = [], n
        while j:
            i, e = back[j]
            path.append((i, j, e))
            j = i
        return path[::-1]

    def sub(self, split: str) -> list[dict] | None:
        if not split:
            return None
        out = []
        for s in split.split("/"):
            e = self.surfaces.get(s) or Entry(s, "名詞-普通名詞-一般")
            out.append({"surface": s, "tag": e.tag, "inf": e.inflection, "lemma": e.lemma or s, "reading": e.reading, "norm": e.norm or s})
        return out

    def sentence(self, text: str) -> tuple[list[dict], list[dict | None]]:
        tokens, subs = [], []
        for i, j, e in self.best(text):
            s = text[i:j]
            if s.isspace():
                if tokens:
                    tokens[-1]["ws"] += s
                continue
            tag = e.tag if e else "補助記号-一般" if _kind(s[0]) == "symbol" else "名詞-数詞" if s.isdigit() else "名詞-普通名詞-一般"
            tokens.append({"orth": s, "ws": "", "lemma": (e and e.lemma) or s, "norm": (e and e.norm) or s, "tag": tag, "pos": "", "ent_iob": "O", "ent_type": "", "reading": (e and e.reading) or None, "inflection": (e and e.inflection) or None, "idx": i})
            a, b = (self.sub(e.a), self.sub(e.b)) if e else (None, None)
            subs.append({"a": a, "b": b} if a or b else None)
        for t, then in zip(tokens, [*tokens[1:], None], strict=False):
            t["pos"] = default_pos(t["orth"], t["tag"], then and then["tag"])[0]
        attach(tokens)
        return tokens, subs


def attach(tokens: list[dict]) -> None:
    """Head-final heads from parts of speech; function words go with what they follow."""
    free = [i for i, t in enumerate(tokens) if t["pos"] not in ("ADP", "AUX", "PUNCT", "SCONJ", "PART")]
    root = free[-1] if free else 0
    for i, t in enumerate(tokens):
        if i == root:
            t["head"], t["dep"] = i, "ROOT"
        elif i in free:
            t["head"] = next(j for j in free if j > i)
            close = t["pos"] in ("NOUN", "PROPN", "NUM") and t["head"] == i + 1
            t["dep"] = ("nummod" if t["pos"] == "NUM" else "compound") if close else "nmod_bunsetu"
        else:
            t["head"] = next((j for j in reversed(free) if j < i), root)
            t["dep"] = {"ADP": "case", "AUX": "aux", "PUNCT": "punct"}.get(t["pos"], "mark")


def annotator(entries: Iterable[Entry] = SMALL, user: Iterable[Entry] = ()):
    words = (*entries, *user)

    def annotate(lines: DataFrame) -> DataFrame:
        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(words)
            subs_type = None
            for batch in batches:
                done = [lattice.sentence(t or "") for t in batch.column(2).to_pylist()]
                subs_type = subs_type or _subs_type()
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([d[0] for d in done], pa.list_(ARROW_TOKEN)), pa.array([d[1] for d in done], pa.list_(subs_type))],
                    ["doc_id", "sent_id", "text", "tokens", "sub_tokens"],
                )

        return lines.select(F.col("doc_id").cast("bigint"), F.col("sent_id").cast("int"), "text").mapInArrow(stage, f"{SENTENCE}, sub_tokens array<{SUBS}>")

    return annotate


def with_words(sentences: DataFrame, mode: str, entries: Iterable[Entry] = SMALL) -> DataFrame:
    """sentences with `spans` (begin, end), the lattice's words in their texts, cut by split mode."""
    words, place = (*entries,), sentences.columns.index("text")
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(words)
        for batch in batches:
            found = []
            for text in batch.column(place).to_pylist():
                tokens, subs = lattice.sentence(text or "")
                cut = split_sentence(tokens, subs, mode) if mode != "C" else tokens
                found.append([{"begin": t["idx"], "end": t["idx"] + len(t["orth"])} for t in cut])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "spans"])

    kinds = _parse_datatype_string("spans array<struct<begin:int,end:int>>")
    return sentences.mapInArrow(stage, StructType([*sentences.schema.fields, *kinds.fields]))


def _subs_type() -> pa.DataType:
    sub = pa.struct([(n, pa.string()) for n in ("surface", "tag", "inf", "lemma", "reading", "norm")])
    return pa.struct([("a", pa.list_(sub)), ("b", pa.list_(sub))])


#: Entries up to which a dictionary goes along with each task.
MOST_ENTRIES = 2_000_000


def read_entries(table: DataFrame, most: int = MOST_ENTRIES) -> list[Entry]:
    """Entries of a dictionary table: surface, tag and any of the other fields; rows without a surface or tag are left out."""
    known = [f.name for f in fields(Entry) if f.name in table.columns]
    rows = table.filter("surface <> '' and tag is not null").select(known).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary has at most {most} entries")
    return [Entry(**{k: v for k, v in r.asDict().items() if v is not None}) for r in rows]


def annotate(lines: DataFrame) -> DataFrame:
    return annotator()(lines)
