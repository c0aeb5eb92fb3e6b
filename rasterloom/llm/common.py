"""Shared pieces of the training-data operators: scratch tables, ranks, joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Separators between words: space, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java character class.
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
#: A key with more than 1 / HOT of all rows is hot; there are at most HOT of them.
HOT = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only with a local master, where driver and executors are one process, a temporary
    folder takes its place if it is unset; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (jdir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = jdir.get()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage between the steps of a job.

    A lost executor costs a re-read of these files, never a recomputation of the
    steps before them. ``drop`` frees a table that no later step reads, ``close`` all
    of them; as a result still reads some, only who has written it can close.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/rl-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def keep(self, df: DataFrame, **seen: Column) -> DataFrame:
        """Writes and reads back. ``seen`` are aggregates that the same pass computes, as ``.seen`` by name."""
        self.n += 1
        path = f"{self.base}/t{self.n}"
        watch = Observation()
        watched = df.observe(watch, *[c.alias(n) for n, c in seen.items()]) if seen else df
        watched.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._rl_path, out.seen = path, watch.get if seen else {}
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and hasattr(t, "_rl_path"):
                self._delete(t._rl_path)

    def close(self) -> None:
        self._delete(self.base)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = F.trim(whole(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE_CLASS}+"))


def word_count(text: Column) -> Column:
    """Number of words without building them: word starts, each a non-space after a space."""
    marked = F.concat(F.lit(" "), F.translate(whole(text), SPACES[1:], " " * 5))
    return F.regexp_count(marked, F.lit(" [^ ]")).cast("long")


def fan_out(rows: int, per_bucket: int = 50_000) -> int:
    """Number of hash buckets that keeps each one near ``per_bucket`` rows."""
    return max(16, -(-rows // per_bucket))


def prefix_offsets(buckets: DataFrame, group: list[str], bucket: str, total: str, out: str) -> DataFrame:
    """``out``: sum of ``total`` over the buckets before this one, within its group."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumn(out, F.coalesce(F.sum(total).over(w), F.lit(0).cast("long")))


def ranked(rows: DataFrame, group: list[str], order: list[str], scratch: Scratch, out: str = "rank") -> DataFrame:
    """``rows`` with their place from 0 within ``group`` in the order of ``order`` (nulls first), whatever a group's share.

    One sort by range numbers the rows of each range, and written with them the numbers do not
    change. A group's rows lie in ranges one after another: places are counts of the ranges
    before, plus the number within the range. Rows that agree in all of ``order`` would share a range.
    """
    by = [*group, *order]
    t = scratch.keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__n", F.monotonically_increasing_id()), rows=F.count(F.lit(1)))
    t = t.withColumn("__range", F.shiftright("__n", 33))
    g = [f"__g{i}" for i in range(len(group))]
    ranges = t.groupBy(*[F.col(c).alias(n) for c, n in zip(group, g)], F.col("__range").alias("__of")).agg(F.count("*").alias("__c"), F.min("__n").alias("__low"))
    ranges = prefix_offsets(ranges, g, "__of", "__c", "__before")
    same = F.col("__range") == F.col("__of")
    for c, n in zip(group, g):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return t.join(ranges, same).withColumn(out, F.col("__n") - F.col("__low") + F.col("__before")).drop("__n", "__range", "__of", "__c", "__low", "__before", *g)


def attach(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``table``, one row per ``key`` with ``c``, the rows of that key, to ``rows``, whatever a key's share.

    Keys with more than ``total / HOT`` rows, of which there are at most ``HOT``, are
    broadcast, so their rows stay where they are; the others are shuffled, and none of
    those holds more than ``1 / HOT`` of the rows. ``how`` is inner or left; null keys
    find nothing.
    """
    hot = F.broadcast(table.where(F.col("c") * HOT > total))
    cold = table.where(F.col("c") * HOT <= total)
    some = rows.where(F.col(key).isNotNull())
    out = some.join(hot, key).unionByName(some.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))
    return out if how == "inner" else out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def with_numbers(rows: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ids as whole numbers that sort as the ids do, and the table of both (``__id, __no``); None if they are whole numbers."""
    if dict(rows.dtypes)[key] in WHOLE_NUMBERS:
        return rows.withColumn(key, F.col(key).cast("long")), None
    ids = rows.select(F.col(key).alias("__id")).where("__id is not null").distinct()
    names = scratch.keep(ranked(ids, [], ["__id"], scratch, "__no"))
    return rows.join(names, F.col(key) == F.col("__id"), "left").withColumn(key, F.col("__no")).drop("__id", "__no"), names


def with_ids(found: DataFrame, columns: list[str], names: DataFrame | None, scratch: Scratch) -> DataFrame:
    """``found`` with the ids that its numbers in ``columns`` stand for, whatever the share of one of them."""
    order = found.columns
    for c in columns if names is not None else []:
        found = scratch.keep(found, rows=F.count(F.lit(1)))
        table = names.join(found.groupBy(F.col(c).alias("__no")).agg(F.count("*").alias("c")), "__no").withColumnRenamed("__no", c)
        found = attach(found, table, c, found.seen["rows"], "left").withColumn(c, F.col("__id")).drop("__id", "c")
    return found.select(order)


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of each node with an edge: columns ``node``, ``component``.

    Alternating large-star and small-star steps, until one changes nothing: each is a
    grouped minimum and a join on the node. Hubs pre-aggregate before the shuffle of the
    minimum and are broadcast in the join, so no task holds a hub's edges, and nothing is
    collected. The number of steps grows with the logarithm of the longest path.
    """
    mark = {"rows": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v")), "y": F.bit_xor(F.xxhash64("v", "u", F.lit(1)))}
    cur = scratch.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), **mark)
    while n := cur.seen["rows"]:
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("m", "u"))
        large = scratch.keep(attach(sym.where("v > u"), low, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = (attach(large, low, "u", n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        nxt = scratch.keep(small, **mark)
        scratch.drop(cur, large)
        last, cur = cur.seen, nxt
        if cur.seen == last:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
