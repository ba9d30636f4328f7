"""Command line: analyze, morphemes, evaluate, convert, bench."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fields
from .operators import evaluate, formats
from .plans.registry import Settings, analyse, find
from .sources import conllu, gold, lines, sinks


def session(parallel: int) -> SparkSession:
    cpus = os.cpu_count() or 1
    level = parallel if parallel > 0 else max(1, cpus + parallel)
    return SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{level}]")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def sizes(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kozue", description="Linguistic analytics over text.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "morphemes"):
        a = sub.add_parser(name)
        a.add_argument("-b", "--annotator", default=None, help="an annotator's name")
        a.add_argument("-m", "--fallback", default=None, help="names to try in turn, by commas")
        a.add_argument("-s", "--split-mode", default="C", choices=("A", "B", "C"))
        a.add_argument("-c", "--hash-comment", default="print", choices=lines.COMMENT_MODES)
        a.add_argument("-o", "--output-path", help="a file; or a folder, whose name ends with /, for parts that tasks write")
        a.add_argument("-g", "--require-gpu", action="store_true", help="taken and ignored: annotators run where Spark runs them")
        a.add_argument("-f", "--output-format", default="mecab" if name == "morphemes" else "conllu")
        a.add_argument("-n", "--normalized", action="store_true", default=name == "morphemes")
        a.add_argument("-d", "--no-sentences", action="store_true")
        a.add_argument("-r", "--orth-for-reading", action="store_true")
        a.add_argument("-p", "--parallel", type=int, default=-1 if name == "morphemes" else 1)
        a.add_argument("files", nargs="*")
    e = sub.add_parser("evaluate")
    e.add_argument("system", help="CoNLL-U of the system; or with -b, an annotator's name")
    e.add_argument("-b", "--annotator", action="store_true", help="annotate the texts of the gold sentences")
    e.add_argument("gold", nargs="+", help="gold JSON")
    c = sub.add_parser("convert")
    c.add_argument("source", nargs="*", default=["-"], help="CoNLL-U files or folders; - is standard input")
    c.add_argument("-n", "--per-paragraph", type=sizes, default=[10], help="sentences of a paragraph: a number, 0 for no limit, below 0 for drawn lengths; several by commas go to folders of their own")
    c.add_argument("-r", "--retokenize", choices=("A", "B", "C"), help="merge tokens to the lattice's in this split mode")
    c.add_argument("-e", "--extend-dep-labels", action="store_true", help="mark relations of bunsetu heads")
    c.add_argument("-p", "--paragraph-id-regex", help="the first group of a sentence id is its paragraph's")
    c.add_argument("-a", "--augmentation", action="store_true", help="add sentences with swapped widths")
    c.add_argument("-d", "--ensure-end-period", action="store_true", help="paragraphs end with a full stop")
    c.add_argument("-l", "--luw-ent", action="store_true", help="long units in place of entities")
    c.add_argument("-o", "--output-path", required=True)
    b = sub.add_parser("bench")
    b.add_argument("annotators", nargs="+")
    b.add_argument("-k", "--repeats", type=int, default=5)
    return p


def run_lines(spark: SparkSession, source: DataFrame, args: argparse.Namespace) -> DataFrame:
    """file_no, line_no, sent_id, out in no order: comments as they are, and analysed lines."""
    choice = formats.format_name(args.output_format)
    mode = args.hash_comment
    if choice == "json" and mode == "print":
        print("comments can't be printed in JSON; they are analysed", file=sys.stderr)
        mode = "analyze"
    marked = lines.comments(source, mode)
    names = tuple((args.annotator or args.fallback or ("lattice" if args.command == "morphemes" else "seed")).split(","))
    # A line's place is its id, so nothing has to be joined back.
    numbered = marked.filter("kind = 'text'").filter(F.trim("line") != "").select((F.col("file_no").cast("bigint") * (1 << 40) + F.col("line_no")).alias("doc_id"), F.lit(0).alias("sent_id"), F.col("line").alias("text"))
    settings = Settings(annotator=names, split_mode=args.split_mode, split_sentences=not args.no_sentences)
    done = formats.formatted(analyse(numbered, settings, choice != "mecab"), choice, args.normalized, args.orth_for_reading)
    out = done.select(F.shiftright("doc_id", 40).alias("file_no"), F.expr("doc_id & ((1L << 40) - 1)").alias("line_no"), "sent_id", "out")
    said = marked.filter("kind = 'comment'").select(F.col("file_no").cast("bigint"), "line_no", F.lit(0).alias("sent_id"), F.concat("line", F.lit("\n")).alias("out"))
    return out.unionByName(said)


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("analyze", "morphemes"):
        if args.annotator and args.fallback:
            parser().error("-b excludes -m")
        formats.format_name(args.output_format)
        spark = session(args.parallel)
        source = lines.read_lines(spark, args.files) if args.files else lines.read_stdin(spark)
        out = run_lines(spark, source, args)
        as_json = formats.format_name(args.output_format) == "json"
        if args.output_path and args.output_path.endswith("/"):
            sinks.write_parts(out, args.output_path)
        elif args.output_path:
            with open(args.output_path, "w", encoding="utf-8") as f:
                sinks.write_one(out, f, as_json)
        else:
            sinks.write_one(out, None, as_json)
    elif args.command == "evaluate":
        spark = session(-1)
        reference = gold.read_gold(spark, args.gold)
        system = live_parses(reference, args.system) if args.annotator else conllu.read_conllu(spark, args.system).filter("error is null")
        for row in evaluate.report(evaluate.rates(evaluate_texts(reference, system))).collect():
            print(row.line)
    elif args.command == "convert":
        if args.luw_ent and args.retokenize:
            parser().error("-l excludes -r")
        spark = session(-1)
        sentences = conllu.read_conllu(spark, args.source).filter("error is null")
        for n in args.per_paragraph:
            path = args.output_path if len(args.per_paragraph) == 1 else f"{args.output_path.rstrip('/')}/n={n}"
            done = convert(sentences, n, args.extend_dep_labels, args.luw_ent, args.retokenize, args.paragraph_id_regex, args.ensure_end_period, args.augmentation)
            done.select("json").write.text(path)
    else:
        spark = session(-1)
        print(json.dumps(bench(spark, lines.read_stdin(spark), args.annotators, args.repeats)))
    return 0


def live_parses(reference: DataFrame, annotator: str) -> DataFrame:
    """An annotator's sentences of the gold texts, each text once for each time that it is there."""
    numbered = reference.select(F.xxhash64("id", "paragraph").alias("doc_id"), F.col("sent_id").cast("int"), "text")
    return analyse(numbered, Settings(annotator=(annotator,), split_sentences=False), False)


def evaluate_texts(reference: DataFrame, system: DataFrame) -> DataFrame:
    """Counts of a system's sentences against gold ones of the same text; the k-th of equal texts meets the k-th. reference: those of gold
    JSON; system: text, tokens and what orders them (src, place, sent_id; or doc_id, sent_id)."""
    from pyspark.sql import Window

    order = ["src", "place", "sent_id"] if "place" in system.columns else ["doc_id", "sent_id"]

    def numbered(df: DataFrame, by: list[str], tokens: Column) -> DataFrame:
        k = F.row_number().over(Window.partitionBy("text").orderBy(*by))
        return df.withColumn("k", k).select(F.struct("text", "k").alias("sent"), tokens.alias("tokens"))

    g = numbered(reference, ["id", "paragraph", "sent_id"], gold.plain_tokens())
    s = numbered(system, order, F.col("tokens"))
    return evaluate.counts(evaluate.paired(g, s))


def convert(sentences: DataFrame, per_paragraph: int, bunsetu_heads: bool = False, luw: bool = False, retokenize: str | None = None, paragraph_pattern: str | None = None, end_period: bool = False, augment: bool = False) -> DataFrame:
    """Gold JSON documents of parsed CoNLL-U sentences, one a file and `newdoc`. Sentences that aren't projective, have a circle or bad
    labels, or can't be retokenised are skipped."""
    from .operators import treebank
    from .plans import lattice

    ready = treebank.gold_ready(sentences, bunsetu_heads, luw)
    if retokenize:
        merged = treebank.retokenised(lattice.with_words(ready, retokenize))
        ready = treebank.projective(merged).filter("ok").drop("ok", "spans")
    ready = ready.withColumn("doc_id", F.coalesce("newdoc", "src")).withColumn("order", F.struct("place", "sent_id"))
    closes = F.element_at("tokens", -1)["orth"].isin("。", ".") if end_period else None
    group = fields.sentence_paragraph(F.coalesce("sent_id", F.lit("")), paragraph_pattern) if paragraph_pattern else None
    placed = treebank.paragraphs(ready, per_paragraph, "order", closes=closes, group=group)
    if augment:
        # What is swapped makes a paragraph of its own after the one that it comes from.
        placed = treebank.augment_width(placed, ["doc_id", "sent_id"]).withColumn("paragraph", F.col("paragraph") * 2 + F.col("copy"))
    named = placed.select("doc_id", "paragraph", F.col("order").alias("sent_id"), "text", formats.gold_tokens().alias("tokens"))
    return gold.to_gold(named, ["doc_id"])


def bench(spark: SparkSession, source: DataFrame, annotators: Sequence[str], repeats: int = 5) -> dict:
    """Milliseconds a line for each annotator: the upper median of the repeats."""
    numbered = source.select(F.col("line_no").alias("doc_id"), F.lit(0).alias("sent_id"), F.col("line").alias("text")).cache()
    n = max(1, numbered.count())
    times = []
    for name in annotators:
        find(name)
        for _ in range(repeats):
            began = time.perf_counter()
            analyse(numbered, Settings(annotator=(name,))).write.format("noop").mode("overwrite").save()
            times.append((name, (time.perf_counter() - began) * 1000 / n))
    table = spark.createDataFrame(times, "annotator string, msec double")
    return {r.annotator: r.median for r in evaluate.upper_median(table, ["annotator"], "msec").collect()}
