"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Each row gets a random key (a hash of seed and doc_id). Within a source, rows lie in
the order of the key; the key's leading digits split that order into ranges of
bounded size, so sums of the ranges before plus a running sum within the range give
each row's place, without sorting a source in one task. Rows without a doc_id take the
hash of their text in its place. A source's budget cuts that
order exactly; budgets above the source's size repeat it in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prefix_offsets, whole, word_count

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating
SHARE = 1.5  # of all sizes, shared out
MOST = 2  # times its size, at most, from each source
SEED = "mix"
PER_RANGE = 50_000


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from one row per source with its ``source_size``.

    Shares go by weight; a source stops at ``MOST`` times its size and the excess is
    shared again (windows over one row per source, which are few). That is one level: target = least(MOST * size, weight * level), found
    by adding sources in the order of the level at which they stop.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("cap", MOST * F.col("source_size"))
    stop = (F.col("cap") / F.col("weight"))
    by = Window.orderBy("stop", F.col("source").isNull(), "source")
    s = s.withColumn("stop", stop)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    s = s.withColumn("open", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(Window.partitionBy()) - F.col("full")) / F.col("open"))
    # The first source in that order that the level does not stop holds the level of all.
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(Window.partitionBy())["level"]
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, scratch: Scratch | None = None, size: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, and the columns in ``keep``.

    ``size`` counts the words of the text (null: 0). ``taken`` is how many words the mix
    takes, repeats counted; it is a whole number of copies for all but the one document
    at which a source's budget ends, of which the first words are taken. Null sources
    form the last source; rows that share a random key (an id, or without one a text)
    are ordered by size; texts of any length count as a whole; other columns are ignored;
    an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    size = word_count(F.col("text").cast("string")) if size is None else size
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(whole(F.col("text").cast("string")).cast("binary"))))
    key = F.md5(F.concat(F.lit(f"{SEED}:"), own))
    rows = scratch.keep(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *(keep or [])))
    count = rows.count()
    digits = 2
    while 16 ** digits * PER_RANGE < count * 4:
        digits += 1
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = prefix_offsets(ranges, ["source"], "range", "n", "before")
    goal = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")))
    plan = (before.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
            .select(F.col("b.source").alias("of"), F.col("b.range").alias("in"), "before", "source_size", "target"))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")), "left")
    budget = F.floor(F.col("target")).cast("long")
    whole_runs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    left = budget - whole_runs * F.col("source_size") - F.col("before") - F.col("start")
    part = F.least(F.greatest(left, F.lit(0).cast("long")), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", (whole_runs * F.col("size") + part).alias("taken"), *(keep or []))


def mixed_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, the last one cut to its words.

    Documents without words weigh nothing; those of a source that is taken whole stay, once.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    row = docs.select("doc_id", "source", "text", F.struct("*").alias("__row"))
    m = mix(row, scratch, keep=["__row"])
    copies = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0))
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0).cast("long"))
    n = (copies + F.when(rest > 0, 1).otherwise(0)).cast("int")
    each = m.select("__row", "size", rest.alias("__rest"), F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("__i"), copies.alias("__c"))
    text = F.col("__row.text")
    # Blanks before each word stay with it: the first words of a text, as they stand.
    cut = F.array_join(F.slice(F.split(whole(text), "(?<=[^ \\t\\n\\x0B\\f\\r])(?=[ \\t\\n\\x0B\\f\\r])"), 1, F.col("__rest").cast("int")), "")
    new = F.when(F.col("__i") > F.col("__c"), cut).otherwise(text)
    fields = docs.columns
    return each.select(*[new.alias(c) if c == "text" else _fixed(c, new) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in fields])


def _fixed(name: str, text: Column) -> Column:
    """``n_chars`` of the text as the mix takes it."""
    own = F.col(f"__row.`{name}`")
    return F.when(F.col("__i") > F.col("__c"), F.length(text).cast("long")).otherwise(own).alias(name)


#: DuckDB twin over whole tables.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda s: s <> ''))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
    2 * source_size AS cap FROM s),
o AS (
  SELECT *, cap / weight AS stop,
    (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
v AS (SELECT arg_min(level, stop) AS level FROM o WHERE level <= stop),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * v.level, cap::DOUBLE)) AS target FROM o LEFT JOIN v ON true),
p AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    (sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + least(greatest(budget % source_size - start, 0), size) END::BIGINT AS taken
FROM p
"""
