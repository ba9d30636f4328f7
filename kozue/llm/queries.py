"""Queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import bpe, chat, embeddup, exactdedup, langid, minhash, mixing, quality, suffix, tokencount

#: Shares of the mixture, relative to each other; sources not named have a weight of 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
BUDGET_FRACTION = 0.5


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), WEIGHTS, budget_fraction=BUDGET_FRACTION)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.train(documents, read_table(spark, sf_dir, "labels")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_classes(read_table(spark, sf_dir, "embeddings"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exactdedup.exact_dedup(documents, copies_col="n_copies").select("doc_id", "n_copies")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return langid.identify(documents, *langid.train(documents))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(read_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_token_counts,
        op3_quality,
        op4_embedding_near_dedup,
        op5_chat_formatting,
        op6_exact_dedup,
        op7_bpe,
        op8_language_id,
        op9_suffix_dedup,
        op10_minhash,
    )
}

_WORD = r"[^ \t\n\r\f\x0b]+"
_WEIGHT = "CASE source " + " ".join(f"WHEN '{s}' THEN CAST({w} AS DOUBLE)" for s, w in WEIGHTS.items()) + " ELSE CAST(1.0 AS DOUBLE) END"

ORACLES: dict[str, str] = {
    "op1_mixing": f"""
        WITH q AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(text, '{mixing.WORD}')) AS BIGINT) AS tokens,
                   md5('{mixing.SEED}:' || doc_id) AS shuffle_key, {_WEIGHT} AS weight
            FROM documents),
        t AS (
            SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY shuffle_key, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / weight AS finish_time
            FROM q),
        s AS (
            SELECT *, CAST(sum(tokens) OVER (ORDER BY finish_time, source, shuffle_key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
            FROM t)
        SELECT doc_id, source, tokens, finish_time, served
        FROM s WHERE served <= (SELECT floor(sum(tokens) * {BUDGET_FRACTION}) FROM q)""",
    "op6_exact_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text",
    "op4_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS MATERIALIZED (SELECT r, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
        p AS MATERIALIZED (
            SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r
            WHERE list_inner_product(a.e, b.e) / a.norm / b.norm >= {embeddup.COSINE}),
        w AS (SELECT r, vec_id AS low FROM v UNION SELECT p.y, w.low FROM w JOIN p ON p.x = w.r)
        SELECT v.vec_id, c.class_id, coalesce(n, 0) AS n_links
        FROM v JOIN (SELECT r, min(low) AS class_id FROM w GROUP BY r) c ON c.r = v.r
        LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY x) l ON l.x = v.r""",
    "op5_chat_formatting": f"""
        SELECT conv_id, count(*) AS n_messages,
               string_agg('{chat.BEGIN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{chat.END}' || chr(10), '' ORDER BY turn) AS rendered
        FROM conversations GROUP BY conv_id""",
    "op9_suffix_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents),
        x AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d WHERE len(w) >= {suffix.THRESHOLD}),
        g AS (SELECT r, doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {suffix.THRESHOLD - 1} FOLLOWING)) AS gram, n FROM x),
        k AS (SELECT *, count(*) OVER (PARTITION BY gram) AS times FROM g WHERE i <= n - {suffix.THRESHOLD}),
        p AS (SELECT r, doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {suffix.THRESHOLD}, true) AS begins FROM k WHERE times > 1),
        s AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM p)
        SELECT doc_id, CAST(min(i) AS INTEGER) AS first_word, CAST(max(i) - min(i) + {suffix.THRESHOLD} AS INTEGER) AS n_words FROM s GROUP BY r, doc_id, island""",
    # The definition; that banding and the sequential test miss nothing of it on a given table is not certain.
    "op10_minhash": f"""
        WITH RECURSIVE t AS (SELECT text, min(doc_id) AS first, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text),
        w AS (SELECT first, regexp_extract_all(text, '{_WORD}') AS w FROM t),
        s AS (SELECT DISTINCT first, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w WHERE len(w) > 0),
        n AS (SELECT first, count(*) AS n FROM s GROUP BY first),
        b AS (SELECT a.first AS x, b.first AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.first <> b.first GROUP BY 1, 2),
        p AS MATERIALIZED (SELECT x, y FROM b JOIN n a ON a.first = x JOIN n c ON c.first = y WHERE shared >= {minhash.THRESHOLD} * (a.n + c.n - shared)),
        r AS (SELECT first, first AS low FROM t UNION SELECT p.y, r.low FROM r JOIN p ON p.x = r.first),
        c AS (SELECT first, min(low) AS class_id FROM r GROUP BY first)
        SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.n, 0) AS n_links, coalesce(t.n_copies, 1) AS n_copies
        FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN c ON c.first = t.first LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY x) l ON l.x = t.first""",
}
