"""Merkle manifest of a dataset: content-addressed nodes, proofs by descent from the root.

A row's leaf is the SHA-256 of its fields. Within a source, leaves ascend by doc_id and every
``FAN`` neighbours become the digest of their digests until one is left; the sources'
nodes become the root in the same way. The manifest is a store of records, digest to
children, one table per height.

A proof is found by descent: a request starts at the root and the digits of its rank, base
``FAN``, tell which child to take; the children that are not taken are a segment of its
path, and the segments in reverse order are the proof. All requests below a node share its
path, so it is carried once per node and handed on to children, never once per leaf: a path
lives in one row per ``FAN`` leaves until the last step, which hashes it in place.

Ranks come from a sort by ranges (``common.ranked``), so no task holds a source. Grouping
takes ``FAN`` rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "struct<left: string, right: string>"


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def build(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Trees over ``tree, n, idx, digest`` (``n`` nodes of a tree, ``idx`` their places from 0).

    Gives ``tree, height, digest`` of the roots and, for heights from 1, the store's records
    ``digest, children``.
    """
    records, roots, height = [], None, 0
    while True:
        done = nodes.where("n = 1").select("tree", F.lit(height).alias("height"), "digest")
        roots = done if roots is None else roots.unionByName(done)
        most = nodes.agg(F.max("n")).first()[0]
        if (most or 1) == 1:
            return roots, records
        height += 1
        run = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"idx div {FAN}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("c"))
        run = run.select("tree", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("at").alias("idx"), F.col("c.digest").alias("children"))
        run = scratch.keep(run.withColumn("digest", F.sha2(F.array_join("children", ""), 256)))
        records.append(run.select("digest", "children"))
        nodes = run.select("tree", "n", "idx", "digest")


def _without(children: Column, at: Column) -> Column:
    """Segment of a path: the children before and after the one that is taken."""
    return F.struct(F.array_join(F.slice(children, 1, at), "").alias("left"), F.array_join(F.slice(children, at + 2, FAN), "").alias("right"))


def descend(starts: DataFrame, records: list[DataFrame], requests: DataFrame) -> DataFrame:
    """Runs that hold requested leaves: ``tree, idx`` (of the run), ``children`` and the ``path`` from the root down to the run.

    ``starts``: ``tree, height, digest, path``; ``requests``: ``tree, rank``. Trees of one leaf
    give that leaf as a run without children.
    """
    front = lone = starts.where("height = 0").select("tree", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("array<string>").alias("children"), "path")
    front = None
    for height in range(len(records), 0, -1):
        new = starts.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("idx"), "digest", "path")
        front = new if front is None else front.unionByName(new)
        store = records[height - 1].groupBy("digest").agg(F.first("children").alias("children"))
        runs = front.join(store, "digest")
        if height == 1:
            return runs.select("tree", "idx", "children", "path").unionByName(lone)
        child = runs.select("tree", "idx", "path", "children", F.posexplode("children").alias("at", "digest"))
        wanted = requests.select(F.col("tree").alias("__t"), F.expr(f"rank div {FAN ** (height - 1)}").alias("__i")).distinct()
        child = child.withColumn("idx", F.col("idx") * FAN + F.col("at")).join(wanted, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("idx") == F.col("__i")), "left_semi")
        front = child.select("tree", "idx", "digest", F.concat("path", F.array(_without(F.col("children"), F.col("at")))).alias("path"))
    return lone


def with_paths(leaves: DataFrame, starts: DataFrame, records: list[DataFrame]) -> DataFrame:
    """``leaves`` (``tree, rank`` and more) with ``path``: the segments from the root down to the leaf."""
    runs = descend(starts, records, leaves.select("tree", "rank")).select(F.col("tree").alias("__t"), F.col("idx").alias("__i"), "children", "path")
    j = leaves.join(runs, F.col("tree").eqNullSafe(F.col("__t")) & (F.expr(f"rank div {FAN}") == F.col("__i")))
    own = F.when(F.col("children").isNull(), F.array().cast(f"array<{SEGMENT}>")).otherwise(F.array(_without(F.col("children"), (F.col("rank") % FAN).cast("int"))))
    return j.withColumn("path", F.concat("path", own)).drop("__t", "__i", "children")


def fold(leaf: Column, proof: Column) -> Column:
    """Root that a leaf gives with the segments of its proof, leaf to root."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, changed: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root``, its ``proof`` (segments leaf to root) and ``altered``.

    ``altered`` is the leaf with ``changed`` as the text (the leaf itself without it). Leaves
    of a source come in the order of doc_id, null ids first, ties by leaf; equal rows
    are leaves of their own. A null source is a source, the first. Null fields are ``-``, empty texts
    ``0:``; texts of any length are hashed whole; other columns do not matter; an empty table
    gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    old = [F.col(c) for c in FIELDS]
    new = leaf([*old[:-1], changed]) if changed is not None else leaf(old)
    rows = docs.select("doc_id", F.col("source").alias("tree"), leaf(old).alias("leaf"), new.alias("altered"))
    # Equal rows are counted before they are sorted, so that many of them do not meet in one range.
    rows = rows.groupBy("doc_id", "tree", "leaf", "altered").agg(F.count("*").alias("c")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).drop("c")
    rows = scratch.keep(ranked(rows, ["tree"], ["doc_id", "leaf", "copy"], scratch))
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n")).withColumnRenamed("tree", "__t")
    nodes = rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, F.col("tree").eqNullSafe(F.col("__t")))
    subroots, records = build(nodes.select("tree", "n", F.col("rank").alias("idx"), F.col("leaf").alias("digest")), scratch)
    subroots = scratch.keep(ranked(subroots.withColumnRenamed("tree", "source"), [], ["source"], scratch), n=F.count(F.lit(1)))
    top = subroots.select(F.lit(0).alias("tree"), F.lit(subroots.seen["n"]).alias("n"), F.col("rank").alias("idx"), "digest")
    roots, above = build(top, scratch)
    roots = scratch.keep(roots)
    starts = with_paths(subroots.withColumn("tree", F.lit(0)), roots.withColumn("path", F.array().cast(f"array<{SEGMENT}>")), above)
    starts = scratch.keep(starts.select(F.col("source").alias("tree"), "height", "digest", "path"))
    out = with_paths(rows, starts, records)
    named = starts.select(F.col("tree").alias("__s"), F.col("digest").alias("subroot")).crossJoin(F.broadcast(roots.select(F.col("digest").alias("root"))))
    out = out.join(F.broadcast(named) if subroots.seen["n"] <= 10_000 else named, F.col("tree").eqNullSafe(F.col("__s")))
    return out.select("doc_id", "leaf", "subroot", "root", F.reverse("path").alias("proof"), "altered")


def verified(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The manifest's digests, and what its proofs say after some texts were lower-cased (ids whose CRC 32 is divisible by 5; null ids never)."""
    text = F.col("text").cast("string")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    m = manifest(docs, F.when(hit, lower).otherwise(text), scratch)
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    m = m.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("altered"), F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc_sql(text: str) -> str:
    """DuckDB: CRC 32 of an ASCII string, with the table ``crc`` of ``CRC_TABLE`` in scope."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_STEP = "SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END AS v FROM "
CRC_TABLE = "crc0 AS (SELECT i, i AS v FROM range(256) g(i)), " + ", ".join(f"crc{k + 1} AS ({_STEP}crc{k})" for k in range(8)) + ", crc AS (SELECT list(v ORDER BY i) AS t FROM crc8)"

LEVELS = 6  # of the SQL twin: up to 16 ** 6 leaves of a source


def _sql() -> str:
    def f(x: str) -> str:
        return f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"

    fields = " || ".join(map(f, FIELDS[:-1]))
    hit = f"coalesce({crc_sql('doc_id::VARCHAR')} % 5 = 0, false)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [CRC_TABLE, f"d AS (SELECT doc_id, source, sha256({fields} || {f('text')}) AS leaf, sha256({fields} || {f(f'CASE WHEN {hit} THEN {lower} ELSE text END')}) AS altered FROM documents CROSS JOIN crc)",
             "p0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS k, count(*) OVER (PARTITION BY source) AS n, altered AS acc, '' AS proof FROM d)",
             "l0 AS (SELECT source AS g, n, k, leaf AS h FROM p0)"]

    def climb(p: str, l: str, g: str) -> None:
        for i in range(LEVELS):
            parts.append(f"{l}r{i} AS (SELECT g, (n + 15) // 16 AS n, k // 16 AS k, list(h ORDER BY k) AS c FROM {l}{i} WHERE n > 1 GROUP BY ALL)")
            parts.append(f"{l}{i + 1} AS (SELECT g, n, k, sha256(array_to_string(c, '')) AS h FROM {l}r{i})")
            left, right = f"array_to_string(c[1:{p}{i}.k % 16], '')", f"array_to_string(c[{p}{i}.k % 16 + 2:], '')"
            parts.append(f"{p}{i + 1} AS (SELECT {p}{i}.* EXCLUDE (n, k, acc, proof), coalesce(r.n, 1) AS n, {p}{i}.k // 16 AS k, CASE WHEN c IS NULL THEN acc ELSE sha256({left} || acc || {right}) END AS acc,"
                         f" proof || coalesce({left} || {right}, '') AS proof FROM {p}{i} LEFT JOIN {l}r{i} r ON r.g IS NOT DISTINCT FROM {p}{i}.{g} AND r.k = {p}{i}.k // 16)")

    climb("p", "l", "source")
    tops = " UNION ALL ".join(f"SELECT g, h FROM l{i} WHERE n = 1" for i in range(LEVELS + 1))
    parts.append(f"s AS ({tops}), t0 AS (SELECT 0 AS g, count(*) OVER () AS n, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS k, h, g AS source FROM s)")
    parts.append(f"q0 AS (SELECT p{LEVELS}.* EXCLUDE (n, k), t0.n, t0.k, t0.h AS subroot, 0 AS z FROM p{LEVELS} JOIN t0 ON t0.source IS NOT DISTINCT FROM p{LEVELS}.source)")
    climb("q", "t", "z")
    root = " UNION ALL ".join(f"SELECT h FROM t{i} WHERE n = 1" for i in range(LEVELS + 1))
    return ("WITH " + ", ".join(parts) + f", root AS ({root}) SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root.h AS verified FROM q{LEVELS} CROSS JOIN root")


#: DuckDB twin over whole tables.
SQL = _sql()
