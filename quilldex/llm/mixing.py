"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within a source the rows are ordered by that key;
token counts are summed per range of the key, ranges per group of ranges, and prefix
sums over those find, for each source, the range in which its budget runs out. Only
the rows of that one range are sorted, so no task ever sorts a source. What is left is
one short row per source: whole epochs, the key at the cut, and the words left there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Work

#: Rows that a range of the key holds on average, over all sources.
RANGE_ROWS = 1000
KEY_BITS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, seed: int) -> Column:
    """A random-looking text for each document; SQL engines agree on it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) -> with target: shares by weight, none above ``most`` times its size.

    Sources by code point, null last, get the weights in turn. Reshaping an excess by
    weight until none is above its limit ends at one level: target = min(limit, level * weight).
    With sources sorted by limit / weight, the level follows from running sums.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights)).cast("int") + 1)
    ranked = sizes.withColumn("w", w.cast("long")).withColumn("limit", F.col("source_size") * most)
    before = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    # fixing a source at its limit raises the level of the rest as long as it is above that limit, then lowers it
    return summed.withColumn("level", F.max(F.col("left") / F.col("left_w")).over(everything)).select(
        "source", "source_size",
        F.least(F.col("limit").cast("double"), F.col("level") * F.col("w")).alias("target"),
    )


def plan_mix(sized: DataFrame, work: Work, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, epochs, cut_key, cut_left, cut_size.

    ``sized`` has source, size, key. Rows below cut_key are in the last epoch, rows at it
    share cut_left words, rows above it are not. cut_key is null where no last epoch is needed.
    """
    n = sized.count()
    bits = min(KEY_BITS - 4, max(2, math.ceil(math.log2(max(1, n) / RANGE_ROWS + 1))))
    number = F.conv(F.substring("key", 1, KEY_BITS // 4), 16, 10).cast("long")
    ranged = sized.withColumn("range", F.shiftright(number, KEY_BITS - bits).cast("int"))
    ranges = work.keep(ranged.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    # sums of groups of ranges come before sums within a group: no window grows with the rows of a source
    coarse = F.shiftright("range", bits // 2)
    groups = ranges.groupBy("source", coarse.alias("grp")).agg(F.sum("words").alias("words"))
    targets = source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    targets = work.keep(
        targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")), "targets"
    )
    running = Window.partitionBy("source").orderBy("grp")
    groups = groups.withColumn("end", F.sum("words").over(running)).withColumn("start", F.col("end") - F.col("words"))
    wanted = targets.filter("rest > 0").select(F.col("source").alias("s"), "rest")
    at_group = groups.join(wanted, F.col("source").eqNullSafe(F.col("s"))).filter("start < rest and rest <= end")
    at_group = at_group.select(F.col("s"), F.col("grp").alias("g"), (F.col("rest") - F.col("start")).alias("rest"))
    in_group = ranges.withColumn("grp", coarse).join(at_group, F.col("source").eqNullSafe(F.col("s")) & (F.col("grp") == F.col("g")))
    inner = Window.partitionBy("source").orderBy("range")
    in_group = in_group.withColumn("end", F.sum("words").over(inner)).withColumn("start", F.col("end") - F.col("words"))
    at_range = in_group.filter("start < rest and rest <= end").select("s", F.col("range").alias("r"), (F.col("rest") - F.col("start")).alias("rest"))
    at_range = work.keep(at_range, "cut-ranges")
    tied = (
        ranged.join(at_range, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    )
    by_key = Window.partitionBy("source").orderBy("key")
    tied = tied.withColumn("end", F.sum("words").over(by_key)).withColumn("start", F.col("end") - F.col("words"))
    cut = tied.filter("start < rest and rest <= end").select(
        F.col("source").alias("s"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("start")).alias("cut_left"), F.col("words").alias("cut_size")
    )
    return work.keep(targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest"), "cuts")


def taken_of() -> Column:
    """Words that the mix takes of a row, from its size and key and its source's plan."""
    last = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.floor(F.col("cut_left") * F.col("size") / F.col("cut_size")))
        .otherwise(0)
    )
    return (F.col("size") * F.col("epochs") + F.coalesce(last, F.lit(0))).cast("long")


def with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan is a written table: Spark broadcasts it below its own size threshold, else it shuffles."""
    return sized.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")), "left")


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Null texts have size 0; a null source is a source, the last. A source without words
    has target 0. Rows that share a doc_id share a key: at the cut they split the words
    left in proportion to their sizes; a very long text is a row like any other, cut within
    it if need be. No rows give no rows. Other columns, whatever their names, don't matter.
    The table of sources, a short row each, is ranked in one task.
    """
    work = Work(docs.sparkSession, "mix")
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key"))
    sized = work.keep(sized, "sized")
    return with_plan(sized, plan_mix(sized, work, weights, most)).select("doc_id", "size", "source_size", "target", taken_of().alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Documents stay whole: the one that the budget cuts is in when at least half of it fits.
    Rows without words are in as often as their source's whole epochs. Only counts are
    shuffled, never texts.
    """
    work = Work(docs.sparkSession, "mixed")
    key = key_of(F.col("doc_id"), seed).alias("key")
    plan = plan_mix(work.keep(docs.select("source", size_of(F.col("text")).alias("size"), key), "sized"), work, weights, most)
    # the text's words are not counted again: whether a row is in depends on its key alone
    # a row's columns travel as one, so that none can clash with the plan's
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", key)
    half = (F.col("key") == F.col("cut_key")) & (F.col("cut_left") * 2 >= F.col("cut_size"))
    times = F.coalesce(F.col("epochs"), F.lit(0)).cast("int") + F.coalesce(((F.col("key") < F.col("cut_key")) | half).cast("int"), F.lit(0))
    return with_plan(keyed, plan).select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("time")).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sources),
summed AS (
  SELECT *,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w
  FROM ranked
  WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (
  SELECT *, max(rest::DOUBLE / rest_w::DOUBLE) OVER () AS level FROM summed),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * w) AS target FROM levelled),
running AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends,
    sum(s.size) OVER (PARTITION BY s.source, s.key) AS tied
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * epochs + CASE
     WHEN size = 0 THEN 0
     WHEN ends <= floor(target) - epochs * source_size THEN size
     WHEN ends - tied < floor(target) - epochs * source_size
       THEN floor((floor(target) - epochs * source_size - (ends - tied)) * size / tied) ELSE 0 END)::BIGINT AS taken
FROM running
"""
