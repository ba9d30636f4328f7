"""Functions of token fields, as Column expressions: they work on columns and on fields of array elements alike."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OTHERS = "OTHERS"
_HALF = "".join(map(chr, range(0x21, 0x7F)))
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
SWAPPED = str.maketrans(_HALF + _FULL, _FULL + _HALF)


@lru_cache(1)
def label_rows() -> list[tuple[str, str, str | None]]:
    """Fine entity label, its coarse label, and its path in the hierarchy if it has one."""
    lines = (Path(__file__).parent / "entity_labels.tsv").read_text(encoding="utf-8").splitlines()
    return [(a, b, c or None) for a, b, c in (line.split("\t") for line in lines)]


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(label_rows(), "ene string, ontonotes string, path string")


def _map(pairs: list[tuple[str, str]]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(a) for a, _ in pairs]), F.array(*[F.lit(b) for _, b in pairs]))


def ontonotes(ene: Column) -> Column:
    """Coarse label; OTHERS for labels that aren't in the table, also for none."""
    return F.coalesce(_map([(a, b) for a, b, _ in label_rows()])[ene], F.lit(OTHERS))


def hierarchy_path(ene: Column) -> Column:
    return _map([(a, c) for a, _, c in label_rows() if c])[ene]


def in_hierarchy(ene: Column, path: str) -> Column:
    """Whether the label is at that place of the hierarchy or below it."""
    own = hierarchy_path(ene)
    return F.coalesce((own == path) | own.startswith(path + "."), F.lit(False))


def _iob(iob: Column, label: Column) -> Column:
    return F.when(iob.isin("B", "I"), F.concat(iob, F.lit("-"), label)).otherwise("O")


def ent_label_ene(iob: Column, ent_type: Column) -> Column:
    return _iob(iob, F.coalesce(ent_type, F.lit("")))


def ent_label_ontonotes(iob: Column, ent_type: Column) -> Column:
    return _iob(iob, ontonotes(ent_type))


def reading_form(reading: Column, orth: Column | None = None) -> Column:
    """Reading; the surface instead if there is none and it is given."""
    return F.coalesce(reading, orth) if orth is not None else reading


def inflection_form(inflection: Column) -> Column:
    return F.replace(F.coalesce(inflection, F.lit("")), F.lit(";"), F.lit(","))


def to_full_width(text: Column) -> Column:
    return F.translate(text, _HALF, _FULL)


def to_half_width(text: Column) -> Column:
    return F.translate(text, _FULL, _HALF)


def swap_width(text: Column) -> Column:
    return F.translate(text, _HALF + _FULL, _FULL + _HALF)


def is_stop(lemma: Column, stop_words: list[str]) -> Column:
    return lemma.isin(stop_words) if stop_words else F.lit(False)


def sentence_paragraph(sent_id: Column, pattern: str) -> Column:
    """Paragraph of a sentence id: the first group of the pattern, else the id itself."""
    found = F.regexp_extract(sent_id, pattern, 1)
    return F.when(found != "", found).otherwise(sent_id)


def file_stem(path: Column) -> Column:
    """Name of a file without folders and endings."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def text_with_ws(orth: Column, ws: Column) -> Column:
    return F.concat(orth, F.coalesce(ws, F.lit("")))
