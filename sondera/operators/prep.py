"""Preparation: dense ids, first-wins dedup, composite keys, item statistics."""

from __future__ import annotations

import contextlib
import functools
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Off, tables dealt out by some of their join keys are joined as they lie.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Rows of a large table whose shuffle files may lie on disk at a time; more are taken in passes.
PASS_ROWS = 9_000_000
#: How settled tables are written: numbers that rise, as places in a bucket do, take a few bits each, and ids no more than their own.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` set to ``value`` for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def passes(df: DataFrame, *keys: str | Column) -> list[Column]:
    """Conditions that deal ``df``'s rows by a hash of ``keys`` into passes of about PASS_ROWS rows: each row meets one, and rows of equal keys the same."""
    n = max(1, math.ceil(df.count() / PASS_ROWS))
    return [F.lit(True)] if n == 1 else [F.pmod(F.xxhash64(*keys), F.lit(n)) == i for i in range(n)]


def settled(df: DataFrame, *more: DataFrame) -> DataFrame:
    """``df`` as Parquet in the folder of ``spark.checkpoint.dir``, for tables that a plan refers to many times; as it is where none is named outside local mode.

    The shuffle files of its plan go when it is written, so the steps of a query do not add up on disk. The rows of ``more``, further
    passes of the same columns, are written one after the other beside those of ``df``.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local") or context.master.startswith("local-cluster") and not named:
            return functools.reduce(DataFrame.unionByName, more, df)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sondera-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/settled-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        for one in (df, *more):
            one.write.mode("append").options(**PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of the settled tables that ``df`` reads, when what was made of them is settled itself; other tables' files stay."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        return
    own = f"{context._jsc.sc().getCheckpointDir().get()}/settled-".split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(own):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def dense_ids(df: DataFrame, order: list[str], bucket: Column, name: str, keep: list[str] | None = None, more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``keep`` (by default all columns) and ids from 0 in the order of the unique key ``order``, without ranking the table in one task.

    ``bucket`` must not fall along that order. The rows of ``more``, further passes, are those of other buckets. Rows are numbered inside buckets and settled, so that what makes them runs once; a
    bucket's first id is the count of all rows before it, from a table with one row a bucket, which is sent to every task.
    """
    keep = keep or df.columns
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    marked = settled(*[x.withColumn("__b", bucket).withColumn("__i", inside).select(*keep, "__b", "__i") for x in (df, *more)])
    counts = marked.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("__b").alias("__at"), F.coalesce(before, F.lit(0)).alias("__start"))
    return marked.join(F.broadcast(starts), F.col("__b").eqNullSafe(F.col("__at"))).drop("__at").withColumn(name, F.col("__start") + F.col("__i")).drop("__b", "__i", "__start")


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def number_keys(df: DataFrame, key: list[str], row_id: str = "row_id", name: str = "qid", bucket_rows: int = 100_000) -> DataFrame:
    """``key`` columns with ids from 0 in the order of first appearance, and that first row."""
    firsts = df.groupBy(*key).agg(F.min(row_id).alias("first_row"))
    return dense_ids(firsts, ["first_row"], F.floor(F.col("first_row") / bucket_rows), name)


def merge_items(preferred: DataFrame, other: DataFrame, key: str = "item_id") -> DataFrame:
    """All items once, the ``preferred`` version first, with the flags ``in_bench`` and ``in_train``."""
    seen = other.select(key).distinct().withColumn("in_train", F.lit(True))
    mine = preferred.join(seen, key, "left").withColumn("in_train", F.coalesce("in_train", F.lit(False))).withColumn("in_bench", F.lit(True))
    rest = other.join(preferred.select(key), key, "left_anti").withColumn("in_train", F.lit(True)).withColumn("in_bench", F.lit(False))
    return mine.unionByName(rest)


def repeats(df: DataFrame, key: Column, name: str) -> DataFrame:
    """ln of the number of rows that share ``key``, by a count and a join: a key that a third of the rows share is one row there."""
    marked = df.withColumn("__k", key)
    counts = marked.groupBy("__k").agg(F.count("*").alias("__n"))
    return marked.join(counts.select(F.col("__k").alias("__k2"), "__n"), F.col("__k").eqNullSafe(F.col("__k2"))).withColumn(name, F.log1p((F.col("__n") - 1).cast("double"))).drop("__k", "__k2", "__n")


def log_positive(c: Column) -> Column:
    """ln(1 + c), with less than 0 as 0; NULL stays NULL."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def relative_price(items: DataFrame, price: str, keys: list[str], name: str = "price_rel_med") -> DataFrame:
    """log price less the log of the median price of the rows with the same ``keys``; NULL where a key is NULL."""
    known = items.where(" and ".join(f"{k} is not null" for k in keys))
    medians = known.groupBy(*keys).agg(F.median(price).alias("__median"))
    return items.join(medians, keys, "left").withColumn(name, log_positive(F.col(price)) - log_positive(F.col("__median"))).drop("__median")


def item_static(items: DataFrame) -> DataFrame:
    """The features of items that no query changes.

    ``items``: item_id, loc, microcat, category, lat, lon, rating, reviews, price, title, descr, params, phone_hidden, msg_forbidden.
    """
    x = relative_price(items, "price", ["loc", "microcat"])
    x = repeats(x, T.strip("descr"), "desc_dup")
    x = repeats(x, T.normalize("title"), "title_dup")
    price = F.col("price")
    return x.select(
        "item_id", "loc", "microcat", "category", "lat", "lon", "rating",
        F.log1p(F.coalesce(F.col("reviews"), F.lit(0)).cast("double")).alias("log_reviews"),
        F.col("rating").isNotNull().cast("int").alias("has_rating"),
        log_positive(price).alias("log_price"),
        F.coalesce(price <= 1, F.lit(False)).cast("int").alias("price_is_1"),
        "price_rel_med",
        F.col("phone_hidden").cast("int").alias("phone_hidden"), F.col("msg_forbidden").cast("int").alias("msg_forbidden"),
        T.word_count("title").alias("title_words"), T.word_count("descr").alias("desc_words"), T.word_count("params").alias("params_words"),
        "desc_dup", "title_dup", T.emoji_share("descr").alias("emoji_share"),
    )
