"""Quality rules with adaptive thresholds, DataFrame operations only.

Every document gets exact counts of its whole text. Five rates are derived from them
and summarised per language and source by a log-bucket quantile sketch: a rate's
bucket is its binary exponent with six more bits (values below 128 are exact), and
a sketch is the count per bucket. Sketches merge by adding counts, so they are built
with partial aggregation, and thin groups fall back on the merged sketch of their
language or of the corpus. Fences derived from the quantiles take the place of fixed
cutoffs and are joined back to the documents. An upper fence lies ``SPREADS`` spreads
above its group's median; the spread is the interquartile range or, where most rates
are 0, the way from the median to the ninth decile. It is capped by the fence that the
language's (and, for rates that hardly depend on the language, the corpus's) sketch
gives at ``CAP_SPREADS``, so that a group full of junk does not lift its own fence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, attach, whole, word_array

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCALE = 1_000_000
#: Rates, each as numerator and denominator: per million, word_len per hundred.
RATES = {
    "symbols": (f"{SCALE} * n_symbols", "word_chars"),
    "dup_lines": (f"{SCALE} * n_dup_lines", "n_lines"),
    "repeats": (f"{SCALE} * n_repeat_words", "n_words"),
    "upper": (f"{SCALE} * n_upper", "word_chars"),
    "word_len": ("100 * word_chars", "n_words"),
}
#: What one occurrence adds to a count: a repeated window is three words.
ONCE = {"symbols": 1, "dup_lines": 1, "repeats": 3, "upper": 1}
#: Lengths of texts, whose medians tell what one occurrence weighs in a group.
LENGTHS = ("word_chars", "n_lines", "n_words")
COUNTS = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "upper": "n_upper"}
BY_LANG = ("upper", "word_len")  # rates that the corpus's sketch does not cap
SPREADS = 4  # fences lie so many spreads from the median
CAP_SPREADS = 6  # the same for the cap
LEAST = 200  # documents of a group that has fences of its own


def text_counts(text: Column) -> dict[str, Column]:
    """Exact counts of a text as columns, by name; ``words`` and ``lines`` are arrays."""
    t = whole(text)
    return {
        "words": word_array(text),
        "lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long"),
    }


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper``
    as struct column ``__q``; all else stays.

    Repeated words: sorting the hashes of a text's three-word windows shows whether
    any occurs again. Only such texts go on to sort (hash, place) pairs; each repeated
    window then covers three words, or as many as lie before the next one.
    """
    c = text_counts(F.col(text))
    d = docs.withColumn("__w", c["words"]).withColumn("__l", c["lines"])
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    d = d.withColumn("__t", F.when(F.size("__h") < 3, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("__h") - 2),
                    lambda i: F.xxhash64(F.get("__h", i - 1), F.get("__h", i), F.get("__h", i + 1)))))
    d = d.withColumn("__s", F.sort_array("__t"))
    d = d.withColumn("__some", F.exists(F.transform("__s", lambda h, i: h.eqNullSafe(F.get("__s", i + 1))), lambda x: x))
    d = d.withColumn("__p", F.when(F.col("__some"), F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("__r", F.when(F.col("__some"), F.sort_array(F.transform(
        F.filter("__p", lambda p, k: F.get("__p", k - 1)["h"].eqNullSafe(p["h"]) | F.get("__p", k + 1)["h"].eqNullSafe(p["h"])),
        lambda p: p["i"]))))
    covered = F.aggregate(F.transform("__r", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__r", k + 1) - p, F.lit(3))).cast("long")),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("__q", F.struct(
        F.size("__w").cast("long").alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"), c["n_upper"].alias("n_upper"),
    )).drop("__w", "__l", "__h", "__t", "__s", "__some", "__p", "__r")


def _rate(name: str) -> Column:
    top, under = RATES[name]
    return F.expr(f"({top}) div greatest({under}, 1L)")


def _bucket(x: Column) -> Column:
    """Log bucket of a non-negative whole number: its exponent and six more bits."""
    e = F.length(F.bin(x)) - 7
    return F.when(x < 128, x.cast("int")).otherwise(e * 64 + F.call_function("shiftright", x, e).cast("int"))


def _value(bucket: str) -> Column:
    """Smallest value of a bucket."""
    b = F.col(bucket)
    return F.when(b < 128, b.cast("long")).otherwise(
        F.call_function("shiftleft", (b % 64 + 64).cast("long"), F.floor(b / 64).cast("int") - 1))


def _group(lang: str, source: str) -> Column:
    """One key of a language and a source, either of which may be null."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    return F.concat(part(lang), F.lit("\0"), part(source))


def thresholds(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per ``lang, source`` with its documents ``c``: a fence for each rate, ``high_<rate>``, and ``low_word_len``."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _bucket(x).alias("bucket")) for r, x in [*((r, _rate(r)) for r in RATES), *((n, F.col(n)) for n in LENGTHS)]]))
    judged = counts.where(~F.col("base_failed"))
    sketch = judged.select("lang", "source", rates.alias("x")).groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))
    q = scratch.keep(_quantiles(sketch))
    groups = counts.groupBy("lang", "source").agg(F.count("*").alias("c"))
    null = F.lit(None)
    own, lang, every = (q.where(F.col("level") == k) for k in range(3))
    out = (groups.alias("g").join(own.alias("o"), F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left")
           .join(lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
           .join(F.broadcast(every.alias("e")), F.lit(True), "left"))  # one row
    cols = []
    for r in RATES:
        def pick(what, r=r):
            return F.coalesce(*[F.when(F.col(f"{k}.docs") >= n, F.col(f"{k}.{what}_{r}")) for k, n in (("o", LEAST), ("l", LEAST), ("e", 0))], null)

        def once(length, r=r):
            # Rounded up, so that it is never nothing.
            return F.expr(f"{SCALE * ONCE[r]}L") / F.greatest(length, F.lit(1).cast("long")) if r in ONCE else F.lit(0.0)

        def cap(k, r=r):
            m = F.col(f"{k}.mid_{r}")
            return m + CAP_SPREADS * F.greatest(2 * (m - F.col(f"{k}.bottom_{r}")), F.col(f"{k}.high_{r}") - m, F.ceil(once(F.col(f"{k}.mid_{RATES[r][1]}"))))
        mid, spread = pick("mid"), F.greatest(pick("top") - pick("bottom"), pick("high") - pick("mid"))
        by_lang = F.when(F.col("l.docs") >= LEAST, cap("l"))
        caps = [F.coalesce(by_lang, cap("e"))] if r in BY_LANG else [by_lang, cap("e")]
        cols.append(F.least(mid + SPREADS * F.greatest(spread, F.ceil(once(pick("mid", RATES[r][1])))), *caps).alias(f"high_{r}"))
        if r == "word_len":
            cols.append((mid - SPREADS * spread).alias("low_word_len"))
    return out.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), F.col("g.c").alias("c"), *cols)


def _quantiles(sketch: DataFrame) -> DataFrame:
    """Quartiles and ninth decile of each rate, one row per ``lang, source`` (``level`` 0), language (1)
    and for the corpus (2): sketches merge by adding the counts of their buckets."""
    no = F.lit(None).cast("string")
    at = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.cast("string").alias("lang"), source.cast("string").alias("source"))
    levels = F.explode(F.array(at(0, F.col("lang"), F.col("source")), at(1, F.col("lang"), no), at(2, no, no)))
    key = ["level", "lang", "source"]
    merged = sketch.select(levels.alias("x"), "rate", "bucket", "n").select("x.*", "rate", "bucket", "n").groupBy(*key, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*key, "rate")  # some dozens of buckets for each power of two
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select(*key, "rate", "bucket", upto.alias("upto"), F.sum("n").over(w).alias("all"))

    def quantile(rate: str, percent: int) -> Column:
        return F.min(F.when((F.col("rate") == rate) & (100 * F.col("upto") >= percent * F.col("all")), _value("bucket")))

    return ranked.groupBy(*key).agg(
        F.max("all").alias("docs"),
        *[quantile(r, p).alias(f"{name}_{r}") for r in RATES for name, p in (("bottom", 25), ("mid", 50), ("top", 75), ("high", 90))],
        *[quantile(n, 50).alias(f"mid_{n}") for n in LENGTHS])


def _spread(counted: DataFrame) -> DataFrame:
    q = counted.select("*", "__q.*").drop("__q")
    return q.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _verdict() -> Column:
    inside = [SCALE * F.col(COUNTS[r]) <= F.col(f"high_{r}") * F.col(RATES[r][1]) + SPREADS * ONCE[r] * SCALE for r in COUNTS]
    inside.append(_rate("word_len") <= F.col("high_word_len"))
    inside.append(_rate("word_len") >= F.col("low_word_len"))
    ok = ~F.col("base_failed")
    for x in inside:
        ok = ok & F.coalesce(x, F.lit(True))  # no fence: nothing passed the base rule
    return ok


#: Rows of fences that are broadcast, at most: 100 bytes each.
FENCES = 50_000


def judge(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``counts`` (kept, with ``rows`` seen) with a ``kept`` column: the base rule, then the fences of its language and source.

    Documents never move: up to ``FENCES`` fences are broadcast. Should there be more
    groups, only those of large groups are, and documents of small groups are joined.
    """
    fences = thresholds(counts, scratch).withColumn("__g", _group("lang", "source")).drop("lang", "source")
    fences = scratch.keep(fences, rows=F.count(F.lit(1)))
    c = counts.withColumn("__g", _group("lang", "source"))
    if fences.seen["rows"] <= FENCES:
        j = c.join(F.broadcast(fences), "__g", "left")
    else:
        j = attach(c, fences, "__g", counts.seen["rows"], "left")
    return j.select(*counts.columns, _verdict().alias("kept"))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed`` and ``kept``.

    A null, empty or blank text has zero counts and fails the base rule; texts of any length count as a whole. Null languages and
    sources form groups of their own. doc_id is passed through, null or repeated;
    other columns are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    counted = with_counts(docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text")))
    counts = scratch.keep(_spread(counted.drop("text")), rows=F.count(F.lit(1)))
    return judge(counts, scratch).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns, whatever their names.

    Null and blank texts go, as they fail the base rule; repeated rows go or stay alike.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    row = docs.select(F.struct("*").alias("__row"), "doc_id", "lang", "source", F.col("text").cast("string").alias("text"))
    counted = scratch.keep(_spread(with_counts(row).drop("text")), rows=F.count(F.lit(1)))
    return judge(counted, scratch).where("kept").select("__row.*")


#: DuckDB twin over whole tables.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT k, unnest(x) AS w, generate_subscripts(x, 1) AS i
  FROM (SELECT k, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS x FROM d)),
g AS (
  SELECT k, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT k, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT k, i + j AS i FROM r, (VALUES (0), (1), (2)) v(j)) GROUP BY k),
l AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT s) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS s FROM d)
  WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY k),
nw AS (SELECT k, count(*) AS n_words FROM w GROUP BY k),
c AS (
  SELECT d.k, doc_id, lang, source, coalesce(n_words, 0) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM d LEFT JOIN nw USING (k) LEFT JOIN l USING (k) LEFT JOIN rep USING (k)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000000 * n_symbols // greatest(word_chars, 1) AS r1, 1000000 * n_dup_lines // greatest(n_lines, 1) AS r2,
    1000000 * n_repeat_words // greatest(n_words, 1) AS r3, 1000000 * n_upper // greatest(word_chars, 1) AS r4,
    100 * word_chars // greatest(n_words, 1) AS r5 FROM c),
s AS (
  SELECT lang, source, rate, CASE WHEN x < 128 THEN x ELSE (x >> (length(bin(x)) - 7)::INT) << (length(bin(x)) - 7)::INT END AS v, count(*) AS n
  FROM (SELECT lang, source, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS rate, unnest([r1, r2, r3, r4, r5, word_chars, n_lines, n_words]) AS x FROM b WHERE NOT base_failed) GROUP BY ALL),
m AS (
  SELECT level, lang, source, rate, v, sum(n)::BIGINT AS n FROM (
    SELECT 0 AS level, lang, source, rate, v, n FROM s UNION ALL SELECT 1, lang, NULL, rate, v, n FROM s UNION ALL SELECT 2, NULL, NULL, rate, v, n FROM s) GROUP BY ALL),
u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY v) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS docs FROM m),
q AS (
  SELECT level, lang, source, rate, max(docs) AS docs, min(v) FILTER (100 * upto >= 25 * docs) AS bottom, min(v) FILTER (100 * upto >= 50 * docs) AS mid,
    min(v) FILTER (100 * upto >= 75 * docs) AS top, min(v) FILTER (100 * upto >= 90 * docs) AS high FROM u GROUP BY ALL),
of(rate, len, once) AS (VALUES (1, 6, 1), (2, 7, 1), (3, 8, 3), (4, 6, 1), (5, 6, 0)),
qo AS (
  SELECT q.*, ceil(1000000.0::DOUBLE * once / greatest(n.mid, 1))::BIGINT AS one
  FROM q JOIN of USING (rate) JOIN q n ON n.rate = of.len AND n.level = q.level AND n.lang IS NOT DISTINCT FROM q.lang AND n.source IS NOT DISTINCT FROM q.source),
f AS (
  SELECT g.lang, g.source, of.rate,
    CASE WHEN o.docs >= 200 THEN o.mid WHEN l.docs >= 200 THEN l.mid ELSE e.mid END AS mid,
    CASE WHEN o.docs >= 200 THEN greatest(o.top - o.bottom, o.high - o.mid) WHEN l.docs >= 200 THEN greatest(l.top - l.bottom, l.high - l.mid) ELSE greatest(e.top - e.bottom, e.high - e.mid) END AS spread,
    CASE WHEN o.docs >= 200 THEN o.one WHEN l.docs >= 200 THEN l.one ELSE e.one END AS one,
    CASE WHEN l.docs >= 200 THEN l.mid + 6 * greatest(2 * (l.mid - l.bottom), l.high - l.mid, l.one) END AS cap_lang,
    e.mid + 6 * greatest(2 * (e.mid - e.bottom), e.high - e.mid, e.one) AS cap_all
  FROM (SELECT DISTINCT lang, source FROM b) g CROSS JOIN of
  LEFT JOIN qo o ON o.level = 0 AND o.rate = of.rate AND o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
  LEFT JOIN qo l ON l.level = 1 AND l.rate = of.rate AND l.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN qo e ON e.level = 2 AND e.rate = of.rate),
k AS (
  SELECT lang, source, rate, mid, spread, CASE WHEN mid IS NULL THEN NULL WHEN rate >= 4 THEN least(mid + 4 * greatest(spread, one), coalesce(cap_lang, cap_all))
    ELSE least(mid + 4 * greatest(spread, one), cap_lang, cap_all) END AS upper FROM f),
h AS (
  SELECT lang, source, max(upper) FILTER (rate = 1) AS h1, max(upper) FILTER (rate = 2) AS h2, max(upper) FILTER (rate = 3) AS h3, max(upper) FILTER (rate = 4) AS h4,
    max(upper) FILTER (rate = 5) AS h5, max(mid - 4 * spread) FILTER (rate = 5) AS l5
  FROM k GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(1000000 * n_symbols <= h1 * word_chars + 4000000, true) AND coalesce(1000000 * n_dup_lines <= h2 * n_lines + 4000000, true)
    AND coalesce(1000000 * n_repeat_words <= h3 * n_words + 12000000, true) AND coalesce(1000000 * n_upper <= h4 * word_chars + 4000000, true)
    AND coalesce(r5 <= h5, true) AND coalesce(r5 >= l5, true) AS kept
FROM b JOIN h ON h.lang IS NOT DISTINCT FROM b.lang AND h.source IS NOT DISTINCT FROM b.source
"""
