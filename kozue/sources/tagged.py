"""Texts with inline entity tags: the outermost tags between <TEXT> and </TEXT> give spans of the text without tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import file_stem

_TAG = re.compile(r"<(/?)([^<>\s/]+)[^<>]*?(/?)>")
SPAN = "struct<label:string,begin:int,end:int>"
SCHEMA = f"file_id string, text string, tags array<{SPAN}>, error string"
_ARROW = pa.schema([("file_id", pa.string()), ("text", pa.string()), ("tags", pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))), ("error", pa.string())])
REJECTED = "rejectedBlock"


def parse_tagged(source: str) -> tuple[str, list[dict]] | None:
    """Text and outermost spans; None for a file that is rejected. Tags must nest."""
    if f"<{REJECTED}" in source:
        return None
    begin, end = source.find("<TEXT>"), source.rfind("</TEXT>")
    if begin < 0 or end < 0:
        raise ValueError("no TEXT")
    body = source[begin + 6 : end]
    out, tags, stack, size, at = [], [], [], 0, 0
    for m in _TAG.finditer(body):
        out.append(body[at : m.start()])
        size += m.start() - at
        at = m.end()
        closing, name, empty = m.groups()
        if empty:
            continue
        if not closing:
            stack.append((name, size))
        elif not stack or stack[-1][0] != name:
            raise ValueError(f"</{name}> at {m.start()} closes {stack[-1][0] if stack else 'nothing'}")
        else:
            label, start = stack.pop()
            if not stack:
                tags.append({"label": label, "begin": start, "end": size})
    if stack:
        raise ValueError(f"{stack[-1][0]} stays open")
    out.append(body[at:])
    return "".join(out), tags


def parse(files: DataFrame) -> DataFrame:
    """file_id, text, tags, error of files (file_id, value); rejected ones are left out."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if parsed := parse_tagged(source or ""):
                        rows.append({"file_id": ident, "text": parsed[0], "tags": parsed[1], "error": None})
                except ValueError as e:
                    rows.append({"file_id": ident, "text": None, "tags": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select(F.col("file_id").cast("string"), "value").mapInArrow(stage, SCHEMA)


def read_tagged(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return parse(raw.select(file_stem(F.col("_metadata.file_path")).alias("file_id"), "value"))


def tag_table(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null").select("file_id", F.inline("tags"))
