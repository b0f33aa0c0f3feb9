"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Slots of one period, rows of one block, and the power of its share that is a source's default weight.
PERIOD, BLOCK_ROWS, TEMPER = 1000, 32, 0.5
#: Rows that are ranked together, about.
RANKED_ROWS = 4096


def _key(column: str = "source") -> Column:
    """A source's name, or a mark of its own for rows without source."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n"))


def period_quotas(sizes: DataFrame, weights: dict[str | None, float] | None, temper: float, period: int) -> DataFrame:
    """``(key, quota, slots)``: whole blocks of each source in a period, by largest remainder; every source has at least one.

    ``sizes(key, n)`` has a row for each source. Weights are the given ones (sources that are not named weigh nothing and get one
    block) or n ** temper.
    """
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        names = [F.lit("n" if k is None else f"s{k}") for k in weights]
        value = F.coalesce(*[F.when(F.col("key") == name, F.lit(float(w))) for name, w in zip(names, weights.values(), strict=True)], F.lit(0.0)) if weights else F.lit(1.0)
        weighed = sizes.withColumn("w", value)
    # one row for each source
    everything = Window.partitionBy(F.lit(0))
    shares = weighed.withColumn("sources", F.count("*").over(everything)).withColumn("total", F.sum("w").over(everything))
    slots = F.greatest(F.lit(period), 10 * F.col("sources")).cast("long")
    spare = F.round(F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1.0 / F.col("sources")) * (slots - F.col("sources")), 6)
    shares = shares.withColumn("slots", slots).withColumn("base", F.floor(spare)).withColumn("rest", spare - F.floor(spare))
    left = F.col("slots") - F.col("sources") - F.sum("base").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("rest"), "key"))
    return shares.withColumn("left", left).withColumn("place", place).select("key", (1 + F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"), "slots")


def period_schedule(quotas: DataFrame) -> DataFrame:
    """``(key, turn, quota, slots, release, deadline, slot)``: the slot of each source's ``turn``-th block (from 0) of a period.

    Block j (from 0) of a source with q of P slots is released at floor(j P / q) and due by ceil((j + 1) P / q). In each slot the
    released block of earliest deadline goes (ties to the first key), a fold over the P slots whose state is the number of blocks
    each source has had. One unit-time server and full use make this feasible: each block goes inside its window, so after
    any slot no source is a whole block ahead of or behind its weight. At the period's end all are level and it repeats.
    """
    one = quotas.agg(F.array_sort(F.collect_list(F.struct("key", "quota"))).alias("q"), F.max("slots").alias("slots"))
    due = lambda j, q, p: F.ceil((j + 1) * p / q)
    start = F.struct(F.transform("q", lambda x: F.lit(0).cast("long")).alias("had"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        ready = F.transform(
            F.arrays_zip(F.col("q"), state["had"]),
            lambda x, i: F.when((x["had"] < x["q"]["quota"]) & (x["had"] * F.col("slots") < (t + 1) * x["q"]["quota"]), F.struct(F.ceil((x["had"] + 1) * F.col("slots") / x["q"]["quota"]).cast("long").alias("due"), i.alias("i"))),
        )
        pick = F.array_min(ready)["i"]
        return F.element_at(F.transform(F.array(pick), lambda k: F.struct(F.transform(state["had"], lambda h, i: h + F.when(i == k, 1).otherwise(0)).alias("had"), F.concat(state["out"], F.array(k)).alias("out"))), 1)

    done = one.where(F.size("q") > 0).select("q", "slots", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), start, step)["out"].alias("out"))
    flat = done.select("slots", "q", F.posexplode("out").alias("slot", "i")).select("slots", F.get("q", F.col("i")).alias("s"), F.col("slot").cast("long").alias("slot"))
    flat = flat.select(F.col("s.key").alias("key"), F.col("s.quota").alias("quota"), "slots", "slot")
    flat = flat.withColumn("turn", (F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1).cast("long"))
    exact = lambda e: F.expr(e).cast("long")
    return flat.select("key", "turn", "quota", "slots", exact("turn * slots div quota").alias("release"), (due(F.col("turn"), F.col("quota"), F.col("slots"))).cast("long").alias("deadline"), "slot")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, temper: float = TEMPER, period: int = PERIOD) -> DataFrame:
    """Every row of ``docs`` with ``__block``, ``__slot``, ``__release``, ``__deadline`` and ``__place`` in its block.

    Within a source, rows are in the order of md5(doc_id) (then doc_id) and cut into blocks of ``block_rows``; the Pfair schedule
    gives each block a slot; ordering by (``__slot``, ``__place``) is the mixture. As long as every source still has blocks, each has its
    weight's share of any prefix to within one block; sources that have run out leave their later slots empty. No row is dropped or
    repeated. Rows without source are a source of their own, rows without doc_id come last in theirs, repeated rows stay.
    An empty table gives an empty result.

    No source is ranked in one task: rows are ranked within buckets of a source's order whose number grows with the table, and a
    bucket's first rank is the count of the rows before it (a table of counts, one row for each bucket).
    """
    names = docs.columns
    # whatever the columns are called, they travel in one
    keyed = docs.select(F.col("doc_id").alias("__id"), _key().alias("__key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    # rows without doc_id are told apart, as far as they can be, by what else they hold
    missing = F.concat(F.lit("~"), F.md5(F.to_json("__row").cast("binary")))
    keyed = keyed.withColumn("__order", F.when(F.col("__id").isNull(), missing).otherwise(F.md5(F.col("__id").cast("string").cast("binary"))))
    sizes = cut(keyed.groupBy(F.col("__key").alias("key")).agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    digits = max(1, math.ceil(math.log(max(1, total / RANKED_ROWS), 16)))
    keyed = keyed.withColumn("__bucket", F.substring("__order", 1, digits + 1))
    counts = keyed.groupBy(F.col("__key").alias("__k"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__k", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__key", "__bucket").orderBy("__order", "__id")
    ranked = keyed.withColumn("__at", F.row_number().over(own) - 1)
    ranked = ranked.join(starts, (F.col("__key") == F.col("__k")) & (F.col("__bucket") == F.col("__b"))).withColumn("__at", F.col("__at") + F.col("__start"))
    plan = cut(period_schedule(period_quotas(sizes, weights, temper, period)))
    plan = plan.select(F.col("key").alias("__pk"), F.col("turn").alias("__turn"), *[F.col(c).alias(f"__plan_{c}") for c in ("quota", "slots", "release", "deadline", "slot")])
    # PERIOD rows, or ten for each source: the bound is on sources, not on documents
    per_source = F.broadcast(plan.select(F.col("__pk").alias("__qk"), F.col("__plan_quota").alias("__quota"), F.col("__plan_slots").alias("__slots")).distinct())
    ranked = ranked.withColumn("__block", F.floor(F.col("__at") / F.lit(block_rows))).withColumn("__place", F.pmod(F.col("__at"), F.lit(block_rows)).cast("int"))
    ranked = ranked.join(per_source, F.col("__key") == F.col("__qk")).withColumn("__cycle", F.floor(F.col("__block") / F.col("__quota")))
    ranked = ranked.withColumn("__t", F.pmod("__block", "__quota"))
    out = ranked.join(F.broadcast(plan), (F.col("__key") == F.col("__pk")) & (F.col("__t") == F.col("__turn")))
    at = {c: (F.col("__cycle") * F.col("__slots") + F.col(f"__plan_{c}")).alias(f"__{c}") for c in ("slot", "release", "deadline")}
    return out.select(*[F.col("__row")[c].alias(c) for c in names], "__block", *at.values(), "__place")


def oracle(block_rows: int = BLOCK_ROWS, temper: float = TEMPER, period: int = PERIOD) -> str:
    """The same in DuckDB's SQL: the schedule is a recursive query, a slot a step."""
    return f"""
WITH RECURSIVE sizes AS (
  SELECT coalesce('s' || source, 'n') AS key, count(*) AS n FROM documents GROUP BY 1),
shares AS (
  SELECT key, pow(n::DOUBLE, {temper}) AS w, count(*) OVER () AS sources, sum(pow(n::DOUBLE, {temper})) OVER () AS total FROM sizes),
spare AS (
  SELECT key, sources, greatest({period}, 10 * sources) AS slots, round(w / total * (greatest({period}, 10 * sources) - sources), 6) AS x FROM shares),
quotas AS (
  SELECT key, slots, CAST(1 + floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, key) <= slots - sources - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM spare),
one AS (
  SELECT list(key ORDER BY key) AS keys, list(quota ORDER BY key) AS q, max(slots) AS p FROM quotas),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS had, CAST(NULL AS BIGINT) AS pick FROM one
  UNION ALL
  SELECT t + 1, list_transform(had, lambda h, i: CASE WHEN i = k THEN h + 1 ELSE h END), k
  FROM (SELECT t, had, p, CAST(list_min(list_filter(list_transform(q, lambda x, i: CASE WHEN had[i] < x AND (had[i] * p) // x <= t + 1
      THEN ((had[i] + 1) * p + x - 1) // x * 1000000 + i END), lambda d: d IS NOT NULL)) % 1000000 AS BIGINT) AS k FROM edf, one WHERE t + 1 < p)),
plan AS (
  SELECT keys[pick] AS key, q[pick] AS quota, p, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf, one WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS nth FROM documents),
blocks AS (
  SELECT r.*, nth // {block_rows} AS block, nth % {block_rows} AS place, quota AS own FROM ranked r JOIN quotas USING (key))
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(block // quota * p + slot AS BIGINT) AS slot,
  CAST(block // quota * p + turn * p // quota AS BIGINT) AS release, CAST(block // quota * p + ((turn + 1) * p + quota - 1) // quota AS BIGINT) AS deadline, CAST(place AS INTEGER) AS place
FROM blocks JOIN plan ON blocks.key = plan.key AND block % own = turn"""


def mixed_order(spark: SparkSession, docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` in the order of the mixture: partitions hold runs of slots in order, and rows are in order within them."""
    del spark
    placed = mix(docs, **options)
    return placed.repartitionByRange("__slot", "__place").sortWithinPartitions("__slot", "__place").select(*docs.columns)
