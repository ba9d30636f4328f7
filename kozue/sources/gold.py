"""Gold JSON: documents of paragraphs of sentences of tokens, with relative heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD_TOKEN = "struct<id:int,orth:string,lemma:string,norm:string,pos:string,tag:string,dep:string,head:int,whitespace:string,ner:string>"
GOLD = f"id string, paragraphs array<struct<raw:string,sentences:array<struct<tokens:array<{GOLD_TOKEN}>>>>>"


def read_gold(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """A row a sentence: id, paragraph, raw, sent_id, text, tokens (as in the file). Files hold one document, or a list of them."""
    docs = spark.read.schema(GOLD).option("multiLine", str(multiline).lower()).json(path)
    return explode_gold(docs)


def explode_gold(docs: DataFrame) -> DataFrame:
    """id, paragraph, raw (the paragraph's text), sent_id, text (of the sentence's tokens), tokens."""
    paragraphs = docs.select("id", F.posexplode("paragraphs").alias("paragraph", "p"))
    sentences = paragraphs.select("id", "paragraph", F.col("p.raw").alias("raw"), F.posexplode("p.sentences").alias("sent_id", "s"))
    text = F.rtrim(F.array_join(F.transform(plain_tokens("s.tokens"), lambda t: F.concat(t["orth"], t["ws"])), ""))
    return sentences.select("id", "paragraph", "raw", "sent_id", text.alias("text"), F.col("s.tokens").alias("tokens"))


def plain_tokens(tokens: str = "tokens") -> Column:
    """Gold tokens as evaluation takes them: heads absolute in the sentence, labels in two."""

    def plain(t: Column, i: Column) -> Column:
        iob = F.coalesce(t["ner"], F.lit("O"))
        ws = F.when(t["whitespace"].isin("true", " "), " ").when(t["whitespace"].isin("false", ""), "").otherwise(F.coalesce(t["whitespace"], F.lit("")))
        kind = F.when(iob.contains("-"), F.regexp_replace(iob, "^[^-]*-", "")).otherwise("")
        return F.struct(
            t["orth"].alias("orth"), ws.alias("ws"), t["pos"].alias("pos"), t["tag"].alias("tag"), t["dep"].alias("dep"),
            (i + t["head"]).alias("head"), F.substring_index(iob, "-", 1).alias("ent_iob"), kind.alias("ent_type"),
        )

    return F.transform(tokens, plain)


def to_gold(sentences: DataFrame, by: list[str]) -> DataFrame:
    """Documents as JSON strings from sentences (by…, paragraph, sent_id, text, gold tokens): columns by…, json."""
    sentence = sentences.groupBy(*by, "paragraph").agg(F.array_sort(F.collect_list(F.struct("sent_id", "text", "tokens"))).alias("ss"))
    texts = F.array_join(F.transform("ss", lambda s: s["text"]), "")
    paragraph = F.struct("paragraph", F.struct(texts.alias("raw"), F.transform("ss", lambda s: F.struct(s["tokens"].alias("tokens"))).alias("sentences")).alias("p"))
    docs = sentence.groupBy(*by).agg(F.array_sort(F.collect_list(paragraph)).alias("ps"))
    first = F.concat_ws("-", *[F.col(c).cast("string") for c in by])
    return docs.select(*by, F.to_json(F.struct(first.alias("id"), F.transform("ps", lambda p: p["p"]).alias("paragraphs"))).alias("json"))
