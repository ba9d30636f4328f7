"""Mixing of sources to target weights by weighted fair queueing.

Every document is put into its source's queue in shuffled order (md5 of a seed and its id). Its virtual finish time is the
number of tokens of its source up to and with it, divided by the source's weight. Served by finish time, the sources' shares of
tokens follow their weights at every point; the stream ends before the document that would exceed the total budget.

Cumulative sums are taken in two steps, so no source or stretch of time is summed in one task: over buckets (a small table), and
over the documents of a bucket. Documents that finish after the fluid limit of the budget can't be served and are left out before
the global range sort.

Cases: a null text has 0 tokens; a null source is a source of its own, with the default weight; null ids come first in an
equal shuffle; ties of finish time go by source, shuffle key, id and text; repeated rows are documents of their own, of which as
many are kept as were served; tokens that are null or negative count as 0; a weight of 0 or less leaves the source out; with no budget or an empty table nothing is served. Extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, fresh, small

SEED = "mix-1"
#: Hexadecimal digits of the shuffle key that make a bucket: 4096 buckets a source.
KEY_DIGITS = 3
TIME_BUCKETS = 4096
WORD = r"[^ \t\n\r\f]+"


#: Replaces a named column of texts by their token counts.
Counter = Callable[[DataFrame, str], DataFrame]


def token_estimate(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def weight_of(source: Column, weights: Mapping[str, float], default: float) -> Column:
    if not weights:
        return F.lit(float(default))
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    return F.coalesce(known[source], F.lit(float(default)))


def _tie(text: Column, tokens_col: str | None) -> Column:
    return (F.xxhash64(text, col(tokens_col)) if tokens_col else F.xxhash64(text)).alias("tie")


def _queue(df: DataFrame, weights: Mapping[str, float], default: float, seed: str, id_col: str, text_col: str, source_col: str, tokens_col: str | None, counter: Counter | None) -> DataFrame:
    """Narrow rows: what the order needs and no text."""
    text = col(text_col)
    tokens = text if counter else col(tokens_col) if tokens_col else token_estimate(text)
    rows = df.select(
        col(id_col).alias("doc_id"),
        col(source_col).alias("source"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(col(id_col).cast("string"), F.lit("")))).alias("shuffle_key"),
        _tie(text, tokens_col),
        weight_of(col(source_col), weights, default).alias("weight"),
        tokens.alias("tokens"),
    ).filter("weight > 0")
    rows = counter(rows, "tokens") if counter else rows
    return rows.withColumn("tokens", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint"))


def finish_times(queue: DataFrame) -> DataFrame:
    """queue with finish_time, from sums over buckets of the shuffle key and within them, and nth, a row's number among those of its
    place in the queue."""
    parts = queue.withColumn("bucket", F.substring("shuffle_key", 1, KEY_DIGITS))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("source", "bucket")
        .agg(F.sum("tokens").alias("bucket_tokens"))
        .select("source", "bucket", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("offset"))
    )
    # Both sides of the join are partitioned by source and bucket; the window that follows needs no further shuffle.
    o = offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset")
    joined = parts.join(o, parts["source"].eqNullSafe(o["o_source"]) & (parts["bucket"] == o["o_bucket"]))
    within = Window.partitionBy("source", "bucket").orderBy("shuffle_key", F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, 0)
    queued = F.col("offset") + F.sum("tokens").over(within)
    # The window above sorts by these very columns, so this one needs no further sort.
    nth = F.row_number().over(Window.partitionBy("source", "bucket", "shuffle_key", "doc_id", "tie").orderBy(F.lit(0)))
    return joined.withColumn("nth", nth).withColumn("queued", queued).withColumn("finish_time", F.col("queued") / F.col("weight")).drop("bucket", "offset", "o_source", "o_bucket")


def budget_of(queue: DataFrame, budget: int | None, fraction: float) -> tuple[int, float]:
    """The budget in tokens, and a time after which no document can be served. It takes two rows a source to the driver's
    arithmetic at most: sums and largest documents are aggregated by source first."""
    per = queue.groupBy("source", "weight").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("largest")).select("weight", "n", "largest")
    whole = per.agg(F.sum("n"), F.sum("largest")).first()
    if whole[0] is None:
        return 0, 0.0
    budget = math.floor(whole[0] * fraction) if budget is None else budget
    need = budget + whole[1] + 1
    # At time t, a source has served min(n, weight t) tokens; sources end in the order of n / weight.
    by_end = Window.orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    ends = per.withColumn("end", F.col("n") / F.col("weight")).groupBy("end").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    total = ends.agg(F.sum("weight")).first()[0]
    served = (
        ends.withColumn("gone", F.coalesce(F.sum("n").over(by_end), F.lit(0)))
        .withColumn("rate", F.lit(total) - F.coalesce(F.sum("weight").over(by_end), F.lit(0.0)))
        .withColumn("time", (F.lit(need) - F.col("gone")) / F.col("rate"))
        .filter("time <= end")
        .agg(F.min_by("time", "end"))  # the first stretch that reaches it
        .first()[0]
    )
    return budget, math.inf if served is None else served * (1 + 1e-9)


#: Sources up to which the last places go to all executors; beyond it, the documents are joined by source.
BROADCAST_SOURCES = 100_000


def _order() -> list[Column]:
    return [F.col("finish_time"), F.col("source").asc_nulls_first(), F.col("shuffle_key"), F.col("doc_id").asc_nulls_first(), F.col("tie")]


def _served(queue: DataFrame, budget: int | None, fraction: float) -> DataFrame:
    budget, horizon = budget_of(queue, budget, fraction)
    timed = finish_times(queue)
    if math.isinf(horizon):
        horizon = queue.groupBy("source", "weight").agg((F.sum("tokens") / F.col("weight")).alias("end")).agg(F.max("end")).first()[0] or 0.0
    else:
        timed = timed.filter(F.col("finish_time") <= horizon)
    slot = F.least(F.floor(F.col("finish_time") * (TIME_BUCKETS / max(horizon, 1e-9))), F.lit(TIME_BUCKETS)).cast("int")
    timed = timed.withColumn("slot", slot)
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = timed.groupBy("slot").agg(F.sum("tokens").alias("n")).select(F.col("slot").alias("o_slot"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("slot").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        timed.join(slots, F.col("slot") == F.col("o_slot"))
        .withColumn("served", F.col("offset") + F.sum("tokens").over(within))
        .filter(F.col("served") <= budget)
    )


def mix(
    df: DataFrame,
    weights: Mapping[str, float],
    default_weight: float = 1.0,
    budget: int | None = None,
    budget_fraction: float = 0.5,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokens_col: str | None = None,
    counter: Counter | None = None,
) -> DataFrame:
    """The served documents in global order of finish time: doc_id, source, tokens, finish_time, served (tokens so far).
    The unit is a token of tokens_col, the column with the documents' counts; of counter, which replaces a column of texts by their counts;
    or a word between white space."""
    queue = checkpointed(_queue(df, weights, default_weight, seed, id_col, text_col, source_col, tokens_col, counter))
    served = _served(queue, budget, budget_fraction)
    served = served.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return served.select("doc_id", "source", "tokens", "finish_time", "served")


def mix_documents(
    df: DataFrame,
    weights: Mapping[str, float],
    default_weight: float = 1.0,
    budget: int | None = None,
    budget_fraction: float = 0.5,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokens_col: str | None = None,
    counter: Counter | None = None,
) -> DataFrame:
    """The whole rows of the served documents. What is served of a source begins its shuffled queue, so the place of its last
    document, a row a source, tells them from the others without moving any text."""
    source_name, cut_name, nth_name = fresh(df, "source", "cut", "nth")
    queue = checkpointed(_queue(df, weights, default_weight, seed, id_col, text_col, source_col, tokens_col, counter))
    served = _served(queue, budget, budget_fraction)
    cuts = served.groupBy(F.col("source").alias(source_name)).agg(F.max(F.struct("shuffle_key", "doc_id", "tie", "nth")).alias(cut_name))
    cuts = small(cuts, BROADCAST_SOURCES)
    place = F.struct(
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(col(id_col).cast("string"), F.lit("")))).alias("shuffle_key"),
        col(id_col).alias("doc_id"),
        _tie(col(text_col), tokens_col),
    )
    joined = df.join(cuts, col(source_col).eqNullSafe(F.col(source_name)))
    cut = F.struct(*[F.col(cut_name)[c].alias(c) for c in ("shuffle_key", "doc_id", "tie")])
    columns = [col(c) for c in df.columns]
    # Rows equal in id and text share the place of the cut: only as many as were served stay.
    last = joined.filter(place.eqNullSafe(cut)).withColumn(nth_name, F.row_number().over(Window.partitionBy(source_name).orderBy(F.lit(0))))
    return joined.filter(place < cut).select(*columns).unionByName(last.filter(F.col(nth_name) <= F.col(cut_name)["nth"]).select(*columns))
