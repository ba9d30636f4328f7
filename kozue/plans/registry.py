"""Annotators by name. An annotator takes lines (doc_id, sent_id, text) and gives sentences with tokens; nothing is installed or fetched."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, fields
from functools import lru_cache
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recognize import DEFAULT_MARKERS, Options, recognize
from ..operators.split import check_mode, split_compounds
from ..schema import ARROW_TOKEN, SENTENCE
from . import lattice, seed

Annotator = Callable[[DataFrame], DataFrame]
_annotators: dict[str, Annotator] = {}
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.]*")


def register(name: str, annotator: Annotator) -> None:
    _annotators[normalize(name)] = annotator


def normalize(name: str) -> str:
    return name.replace("-", "_")


def available() -> list[str]:
    return sorted(_annotators)


def find(*names: str) -> tuple[str, Annotator]:
    """The first of the names that is registered, or that is an importable package of the installed parser library."""
    for name in map(normalize, names):
        if name in _annotators:
            return name, _annotators[name]
        if NAME.fullmatch(name) and find_spec("spacy") and find_spec(name.split(".")[0]):
            return name, external(name)
    raise LookupError(f"no annotator {' or '.join(names)}; registered: {', '.join(available())}")


@lru_cache(4)
def _pipeline(package: str):
    import spacy  # loaded once a worker

    return spacy.load(package)


def external(package: str, batch_size: int = 128) -> Annotator:
    """Annotator that runs a pipeline of the parser library spaCy in the workers; a line may give several sentences."""

    def annotate(lines: DataFrame) -> DataFrame:
        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nlp = _pipeline(package)
            for batch in batches:
                docs, sents, texts, tokens = [], [], [], []
                ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for (d, s), doc in zip(ids, nlp.pipe([t or "" for t in batch.column(2).to_pylist()], batch_size=batch_size), strict=True):
                    for sent in doc.sents:
                        docs.append(d)
                        sents.append(s)
                        texts.append(sent.text)
                        tokens.append([_token(t, sent.start) for t in sent])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sents, pa.int32()), pa.array(texts, pa.string()), pa.array(tokens, pa.list_(ARROW_TOKEN))], ["doc_id", "sent_id", "text", "tokens"])

        return lines.select(F.col("doc_id").cast("bigint"), F.col("sent_id").cast("int"), "text").mapInArrow(stage, SENTENCE)

    return annotate


def _token(t, start: int) -> dict:
    morph = t.morph
    return {
        "orth": t.orth_, "ws": t.whitespace_, "lemma": t.lemma_, "norm": t.norm_, "pos": t.pos_, "tag": t.tag_, "dep": t.dep_, "head": t.head.i - start, "ent_iob": t.ent_iob_ or "O",
        "ent_type": t.ent_type_, "reading": next(iter(morph.get("Reading")), None), "inflection": next(iter(morph.get("Inflection")), None), "idx": t.idx,
    }


@dataclass
class Settings:
    """What a run is to do; as JSON it can be kept beside its results."""

    annotator: tuple[str, ...] = ("seed",)
    split_mode: str | None = "C"
    keep_suffix: bool = False
    markers: tuple[dict, ...] = field(default=DEFAULT_MARKERS)
    least: int = 2
    split_sentences: bool = True

    def __post_init__(self):
        check_mode(self.split_mode)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        known = {f.name for f in fields(cls)}
        values = json.loads(text)
        if unknown := set(values) - known:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def options(self) -> Options:
        return Options(keep_suffix=self.keep_suffix, markers=tuple(self.markers), least=self.least)


def whole_lines(sentences: DataFrame) -> DataFrame:
    """Sentences of one line put together again, as with no splitting into sentences."""
    rows = sentences.groupBy("doc_id", "sent_id").agg(F.collect_list(F.struct("text", "tokens")).alias("ss"))
    shifted = F.transform("ss", lambda s, k: F.struct(s["text"].alias("text"), s["tokens"].alias("tokens"), k.alias("k")))
    rows = rows.withColumn("ss", shifted)
    sizes = F.aggregate("ss", F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(s["tokens"]))))
    tokens = F.flatten(F.transform("ss", lambda s: F.transform(s["tokens"], lambda t: t.withField("head", t["head"] + F.get(F.col("sizes"), s["k"])))))
    return rows.withColumn("sizes", sizes).select("doc_id", "sent_id", F.array_join(F.transform("ss", lambda s: s["text"]), "").alias("text"), tokens.alias("tokens"))


def analyse(lines: DataFrame, settings: Settings | None = None, recognised: bool = True) -> DataFrame:
    """Sentences of lines (doc_id, sent_id, text): annotated, split, and recognised unless only morphemes are wanted."""
    settings = settings or Settings()
    out = find(*settings.annotator)[1](lines)
    if not settings.split_sentences and settings.annotator[0] != "seed":
        out = whole_lines(out)
    out = split_compounds(out, settings.split_mode)
    return recognize(out, settings.options()) if recognised else out


register("seed", seed.annotate)
register("lattice", lattice.annotate)
