"""Repair of conversation structure by weighted CYK parsing of role sequences.

The grammar of a well-formed conversation, ``(s?(ua)+)?`` over role initials, has four
states; the nonterminal ``N(p, q)`` derives what leads from state p to q. In Chomsky normal form its
rules are ``N(p, q) -> N(p, r) N(r, q)`` and, for one row, its edits. A cell of the parse holds for
each nonterminal the least (cost, audit) of the rows of its span: kept, given another role,
deleted. Insertions cost without a row; their closure, the cheapest way from each
state to each other one, stands before every row and at the end.

Cells are combined bottom-up by span length. As every split of a span passes some state, a cell is the same
for each of its splits, so spans of twice the length suffice: linear work for rows, not cubic.
Equal costs with one audit a prefix of the other cannot occur in a cell, since further
insertions cost, so the least audit of a span is made of the least audits of its parts.

Rows get their places by one sort by ranges (digests of texts, not texts). ``BLOCK`` neighbouring rows make a cell in one
task, and ``MERGE`` cells at a time become one, so no task holds a long conversation. Its
audit is one value and its digest one stream, however long; texts are shuffled once for that and
never held.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ranked
from .merkle import CRC_TABLE, crc_sql

BLOCK = 1024
MERGE = 16
STATES = 4  # nothing yet, system, user, assistant
FINAL = (0, 3)
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
INITIALS, FAULTS = "suao", "bdtk"  # role initials (o: any other); blank, duplicate, truncated, none

Cell = tuple  # of STATES * STATES (cost, audit) or None


def _best(options: list):
    return min((x for x in options if x is not None), default=None)


def combine(x: Cell, y: Cell) -> Cell:
    """``N(p, q) -> N(p, r) N(r, q)`` over two neighbouring spans."""
    return tuple(_best([(a[0] + b[0], a[1] + b[1]) for r in range(STATES) if (a := x[p * STATES + r]) and (b := y[r * STATES + q])]) for p in range(STATES) for q in range(STATES))


def _cell(rules: dict) -> Cell:
    return tuple(_best(rules.get((p, q), [])) for p in range(STATES) for q in range(STATES))


@functools.cache
def closure() -> Cell:
    """Insertions alone, as many as it takes."""
    one = _cell({**{(p, p): [(0, "")] for p in range(STATES)}, **{(p, q): [(INSERT, "I")] for (role, p), q in STEPS.items() if role in ROLES}})
    two = combine(one, one)
    return two if two == one else combine(two, two)


@functools.cache
def terminal(symbol: str) -> Cell:
    """A row's edits after any insertions; ``symbol`` is made by ``symbols``."""
    initial, fault = INITIALS[(ord(symbol) - 65) // 4], FAULTS[(ord(symbol) - 65) % 4]
    rules = {(p, p): [(DELETE, "D")] for p in range(STATES)}
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        for (role, p), q in STEPS.items():
            rules.setdefault((p, q), []).extend([(KEEP + more, "K")] * (role == initial) + [(REROLE + more, "R")] * (role in ROLES))
    return combine(closure(), _cell(rules))


def climb(cells: list[Cell]) -> Cell:
    """The cell of all spans together, by spans of twice the length."""
    while len(cells) > 1:
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


@functools.lru_cache(1 << 16)
def span(shape: str) -> tuple[Cell, int]:
    """Cell and illegal neighbours of the rows of a block."""
    roles = [INITIALS[(ord(c) - 65) // 4] for c in shape]
    return climb([terminal(c) for c in shape]), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def parse(cell: Cell | None) -> tuple[int, str]:
    """Least cost and audit of a whole conversation; None has no rows."""
    return (0, "") if cell is None else _best([combine(cell, closure())[q] for q in FINAL])


CELL = "costs array<long>, audits array<string>, illegal long, ends string"


def _columns(cells: list[tuple[Cell, int, str]]) -> list[pa.Array]:
    return [pa.array([[None if x is None else x[0] for x in c] for c, _, _ in cells], pa.list_(pa.int64())), pa.array([[None if x is None else x[1] for x in c] for c, _, _ in cells], pa.list_(pa.string())),
            pa.array([i for _, i, _ in cells], pa.int64()), pa.array([e for _, _, e in cells], pa.string())]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [(*span(shape), shape[0] + shape[-1]) for shape in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_columns(made)], ["conv_id", "block", "costs", "audits", "illegal", "ends"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = []
        for parts in b.column(2).to_pylist():
            cells = [tuple(None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"])) for p in parts]
            seams = "".join(p["ends"] for p in parts)
            made.append((climb(cells), sum(p["illegal"] for p in parts) + sum(span(seams[i:i + 2])[1] for i in range(1, len(seams) - 1, 2)), seams[0] + seams[-1]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_columns(made)], ["conv_id", "block", "costs", "audits", "illegal", "ends"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells = [tuple(None if c is None else (c, a) for c, a in zip(cs, au)) for cs, au in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        done = [parse(c) for c in cells]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([c for c, _ in done], pa.int64()), pa.array([a for _, a in done], pa.string())], ["conv_id", "illegal", "cost", "audit"])


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's repaired rows: a first row (``kind`` 0) brings the audit, the others follow in order."""
    seen, at, state, empty, audit, key = None, 0, 0, True, "", None
    ids, digests, names = [], [], ["conv_id", "repaired_sha256"]

    def put(role: str, text: str) -> None:
        nonlocal empty
        seen.update((("" if empty else "\n") + role + ":" + text).encode())
        empty = False

    def added() -> None:
        """Insertions at this place of the audit."""
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = "a" if state == 2 else "u"
            put(ROLES[role], "")
            state, at = STEPS[role, state], at + 1

    def close() -> None:
        if seen is not None:
            added()
            ids.append(key)
            digests.append(seen.hexdigest())

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for conv, first, role, text, script in zip(*(b.column(i).to_pylist() for i in range(5))):
            if first == 0:
                close()
                seen, at, state, empty, audit, key = hashlib.sha256(), 0, 0, True, script or "", conv
                continue
            added()
            edit, at = audit[at], at + 1
            if edit == "K":
                put(role, text)
                state = STEPS[role[0], state]
            elif edit == "R":
                new = "a" if state == 2 else "u"
                put(ROLES[new], text)
                state = STEPS[new, state]
        if len(ids) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests)], names)
            ids, digests = [], []
    close()
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests)], names)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the stated damage; nulls in texts, roles and hashed ids are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), hit.alias("__hit"))
    return r.where("__hit <> 0").select("*", copies.alias("__copy")).drop("__hit", "__copy")


def repair(rows: DataFrame, ids: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows``: ``conv_id, turn, role, text``; ``ids`` may name conversations without rows, which get
    zeros, an empty audit and the digest of nothing. Rows come by turn, null turns first, rows
    of a turn by role and digest of the pair. Null roles and texts count as one space. Rows without a ``conv_id`` are one
    conversation. Equal rows after the first are duplicates (or blank). Roles count by their first character; one that
    is not s, u or a can only be changed or deleted. Texts of any length count as a whole; other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) * F.when(F.col("role") == "", 0).otherwise(1), F.lit(0)), F.lit(4)) - 1
    small = rows.select("conv_id", "turn", "role", "key", initial.alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    small = scratch.keep(ranked(small, ["conv_id"], ["turn", "role", "key"], scratch).drop("role"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    firsts = small.groupBy(F.col("conv_id").alias("__c"), "key").agg(F.min("rank").alias("__r")).select("__c", "__r", F.lit(True).alias("__new"))
    s = small.join(firsts, same("conv_id", "__c") & (F.col("rank") == F.col("__r")), "left")
    fault = F.when(F.col("blank"), 0).when(F.col("__new").isNull(), 1).when(F.col("open"), 2).otherwise(3)
    s = s.select("conv_id", "turn", "rank", fault.alias("fault"), F.char(65 + 4 * F.col("initial") + fault).alias("symbol"))
    blocks = s.groupBy("conv_id", F.expr(f"rank div {BLOCK}").alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]), "").alias("shape"),
        *[F.sum((F.col("fault") == i).cast("long")).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated"))],
        F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    blocks = scratch.keep(blocks, last=F.max("block"))
    kind = dict(rows.dtypes)["conv_id"]
    cells = blocks.select("conv_id", "block", "shape").mapInArrow(_cells, f"conv_id {kind}, block long, {CELL}")
    last = blocks.seen["last"] or 0
    while last:
        g = cells.groupBy("conv_id", F.expr(f"block div {MERGE}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "costs", "audits", "illegal", "ends"))).alias("parts"))
        cells, last = scratch.keep(g.mapInArrow(_merged, f"conv_id {kind}, block long, {CELL}")), last // MERGE
    parsed = cells.select("conv_id", "costs", "audits", "illegal").mapInArrow(_parsed, f"conv_id {kind}, illegal long, cost long, audit string")
    turns = small.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("*").alias("turns"))
    stats = blocks.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    every = (ids if ids is not None else rows).select(F.col("conv_id").alias("__id")).distinct()
    for t, n in ((stats, "s"), (parsed, "p"), (turns, "t")):
        every = every.join(t.withColumnRenamed("conv_id", f"__{n}"), same("__id", f"__{n}"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    gaps = (wide("hi") - wide("lo") + 1 - wide("turns")).try_cast("long")
    every = scratch.keep(every.select(F.col("__id").alias("conv_id"), F.coalesce(F.when(F.col("turns").isNull(), 0).otherwise(gaps), F.lit(0)).cast("long").alias("gaps"),
                                      *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit")))
    none = F.lit(None)
    stream = every.select("conv_id", F.lit(0).alias("kind"), none.cast("string").alias("role"), none.cast("string").alias("text"), "audit", none.cast("long").alias("turn"), none.cast("string").alias("key"))
    stream = stream.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "role", "text", none.cast("string").alias("audit"), "turn", "key"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key").select("conv_id", "kind", "role", "text", "audit")
    out = stream.mapInArrow(_outputs, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "__d")
    return every.join(out, same("conv_id", "__d")).drop("__d")


def repaired(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``repair`` of the damaged rows, one row per original conversation."""
    return repair(damaged(rows), rows.select("conv_id"), scratch)


def _sql() -> str:
    space = r"'[^\x20\x09-\x0D]'"
    crc = crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return rf"""
WITH RECURSIVE {CRC_TABLE},
 h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations CROSS JOIN crc),
 d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) FROM h WHERE h <> 0),
 o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) AS k,
   md5(strlen(role) || ':' || role || text) AS key FROM d),
 r AS (SELECT *, CASE WHEN NOT regexp_matches(text, {space}) THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, key ORDER BY k) > 1 THEN 'd'
   WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS i,
   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM o),
 stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY 1),
 ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
 step(i, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
 v AS (SELECT conv_id, 0::BIGINT AS k, 0 AS state, {{'c': 0, 'a': ''}} AS best FROM stats
   UNION ALL
   SELECT v.conv_id, v.k + 1, e.q, min({{'c': v.best.c + ins.c + e.c, 'a': v.best.a || ins.a || e.a}})
   FROM v JOIN ins ON ins.p = v.state JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.k = v.k + 1
   JOIN (SELECT p, p AS q, 3 AS c, 'D' AS a, NULL AS i FROM (VALUES (0), (1), (2), (3)) z(p) UNION ALL SELECT p, q, 0, 'K', i FROM step UNION ALL SELECT p, q, 2, 'R', NULL FROM step WHERE i <> 's') x ON x.p = ins.q
   CROSS JOIN LATERAL (SELECT x.q AS q, x.c + CASE WHEN x.a <> 'D' AND r.fault = 't' THEN 1 ELSE 0 END AS c, x.a AS a) e
   WHERE (x.a <> 'K' OR x.i = r.i) AND (x.a = 'D' OR r.fault NOT IN ('b', 'd')) GROUP BY v.conv_id, v.k, e.q),
 best AS (SELECT v.conv_id, min({{'c': v.best.c + ins.c, 'a': v.best.a || ins.a}}) AS b FROM v JOIN stats s ON s.conv_id IS NOT DISTINCT FROM v.conv_id AND s.n = v.k JOIN ins ON ins.p = v.state WHERE ins.q IN (0, 3) GROUP BY 1),
 letters AS (SELECT conv_id, b.a AS audit, unnest(string_split(b.a, '')) AS letter, unnest(range(length(b.a))) AS pos FROM best WHERE b.a <> ''),
 placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS k, count(*) FILTER (letter <> 'D') OVER w - 1 AS slot FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 rows_out AS (SELECT l.conv_id, l.letter, l.pos, l.slot, r.role, r.text, max(CASE WHEN l.slot = 0 AND l.letter = 'K' AND r.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
   FROM placed l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.k = l.k AND l.letter <> 'I'),
 said AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (slot - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS t FROM rows_out WHERE letter <> 'D' GROUP BY 1),
 ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM ids.conv_id"""


#: DuckDB twin over whole tables: the same edits by a recursion over rows, one state at a time.
SQL = _sql()
