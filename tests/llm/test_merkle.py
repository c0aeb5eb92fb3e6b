import hashlib
import random
import zlib

import pytest

from rasterloom.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Levels of a tree over digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k // 16 * 16:k // 16 * 16 + 16]
        out.append((run[:k % 16], run[k % 16 + 1:]))
        k //= 16
    return out


def plain(rows):
    """Rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in by:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = climb([leaf_of(r) for r in by[s]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for k, r in enumerate(by[s]):
            proof = path(trees[s], k) + path(top, i)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of((*r[:4], text))
            for a, b in proof:
                node = h("".join(a) + node + "".join(b))
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[s][-1][0], root, h("".join("".join(a) + "".join(b) for a, b in proof)), node, node == root))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int").repartition(3)
    return sorted((tuple(r) for r in merkle.verified(df).collect()), key=repr)


def table(sizes, seed=1):
    r = random.Random(seed)
    rows = []
    for source, n in sizes:
        rows += [(r.randint(-10**6, 10**12), source, r.choice(["en", None]), r.choice([None, 5]), r.choice(["Ab", "ü", "", None, "low", "UP " * 3])) for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 16), ("b", 1)], [("a", 17), (None, 257), ("ü", 2), ("z", 300)], [(f"s{i}", 1 + i % 3) for i in range(40)]])
def test_equals_plain_trees(spark, sizes):
    rows = table(sizes)
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark, odd_rows):
    rows = [(i, s, la, None if t is None else len(t), t) for i, t, la, s in odd_rows] + [(5, "b", "en", 1, "Q"), (5, "b", "en", 1, "P")] + [(None, None, None, None, None)] * 40
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_some_requests(spark):
    """A descent for some leaves keeps to their branches and gives the same paths."""
    from rasterloom.llm.common import Scratch
    from pyspark.sql import functions as F

    scratch = Scratch(spark)
    leaves = [h(str(i)) for i in range(700)]
    nodes = spark.createDataFrame([(1, 700, i, d) for i, d in enumerate(leaves)], "tree int, n long, idx long, digest string")
    roots, records = merkle.build(nodes, scratch)
    assert roots.first()["digest"] == climb(leaves)[-1][0]
    wanted = spark.createDataFrame([(1, 3), (1, 699)], "tree int, rank long")
    starts = roots.withColumn("path", F.array().cast(f"array<{merkle.SEGMENT}>"))
    assert {(r["tree"], r["idx"]) for r in merkle.descend(starts, records, wanted).collect()} == {(1, 0), (1, 43)}
    for r in merkle.with_paths(wanted, starts, records).collect():
        assert [("".join(a), "".join(b)) for a, b in path(climb(leaves), r["rank"])] == [(s["left"], s["right"]) for s in reversed(r["path"])]
