import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_tree_finds_the_tightest():
    t = sharding.Tree()
    for i, size in enumerate([50, 20, 90, 20]):
        t.add((size, i))
    assert t.take((21, -1)) == (50, 0)
    assert t.take((20, -1)) == (20, 1) and t.take((20, -1)) == (20, 3)
    assert t.take((91, -1)) is None and t.take((1, -1)) == (90, 2)


def one_by_one(sizes, capacity):
    """Best fit decreasing by scanning all bins for every single group: fill of each bin."""
    free = []
    for size in sorted(sizes, reverse=True):
        fits = [(room, i) for i, room in enumerate(free) if room >= size]
        if fits:
            free[min(fits)[1]] -= size
        else:
            free.append(max(capacity, size) - size)
    return free


def test_best_fit_decreasing():
    runs = sharding.best_fit_decreasing([(6, 1), (5, 1), (4, 1), (3, 1), (2, 1)], 10)
    assert runs == [(6, 0, 1, 0), (5, 0, 1, 1), (4, 0, 1, 0), (3, 0, 1, 1), (2, 0, 1, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_a_size_equal_groups_one_by_one(seed):
    import random

    r = random.Random(seed)
    classes = {r.randint(1, 60): r.randint(1, 40) for _ in range(r.randint(1, 25))}
    capacity = r.randint(60, 400)
    free = {}
    for size, _, n, home in sharding.best_fit_decreasing(list(classes.items()), capacity):
        free[home] = free.get(home, capacity) - n * size
    assert [free[i] for i in range(len(free))] == one_by_one([s for s, n in classes.items() for _ in range(n)], capacity)
    runs = sharding.best_fit_decreasing(list(classes.items()), capacity)
    assert {s: sum(x[2] for x in runs if x[0] == s) for s in classes} == classes


def test_size_classes_are_close(spark):
    df = spark.createDataFrame([(x,) for x in (1, 4095, 4096, 4097, 5000, 123_456, 10**9 + 7, 7 * 10**13)], "s long")
    got = {x[0]: x[1] for x in df.select("s", sharding._class(F.col("s"))).collect()}
    assert all(v == s if s <= 4096 else s <= v <= s * 1.001 for s, v in got.items())


def test_many_small_groups_are_packed_as_groups(spark):
    # Far more groups than there once were lumps: all of one text share a shard, and shards are equal to 0.1 %.
    rows = [(i, f"{i // 2} " * (1 + i // 2 % 9)) for i in range(20_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    sizes = check(got, dict(rows), 16)
    homes = defaultdict(set)
    for r in got:
        homes[r["doc_id"] // 2].add(r["shard"])
    assert len(sizes) == 16 and all(len(h) == 1 for h in homes.values()) and max(sizes.values()) <= 1.001 * min(sizes.values())


def check(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    return {s: sum(r["size"] for r in x) for s, x in by.items()}


def test_shards_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    rows = sharding.shard(docs, 16).collect()
    sizes = check(rows, texts, 16)
    assert len(rows) == len(texts) and max(sizes.values()) <= 1.05 * min(sizes.values())
    homes = defaultdict(set)
    for r in rows:
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_above_a_share_is_divided(spark):
    rows = [(i, "same text of some length" if i % 3 == 0 else f"own text number {i}") for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    sizes = check(got, dict(rows), 16)
    assert max(sizes.values()) <= 1.1 * sum(sizes.values()) / 16


def test_odd_rows(docs_of, odd_rows):
    rows = sharding.shard(docs_of(odd_rows), 4).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((x[0] is None, x[0] or 0) for x in odd_rows)
    assert {r["shard"] for r in rows if r["doc_id"] in (1, 2)} != set() and {r["text_crc32"] for r in rows if r["doc_id"] == 1} == {0}
    assert sharding.shard(docs_of([]), 4).collect() == []


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = goal / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            goal -= 2 * sizes[s]
        open_ -= full
    return target


def mix_rows(spark, seed, n):
    import random

    r = random.Random(seed)
    return [(i, " ".join("w" * r.randint(1, 3) for _ in range(int(r.paretovariate(1)) % 400)), "en", r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_budgets(spark, docs_of, seed):
    rows = mix_rows(spark, seed, 400)
    got = mixing.mix(docs_of(rows)).collect()
    text = {r[0]: r for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = text[r["doc_id"]][3]
        assert r["size"] == len(WORD.findall(text[r["doc_id"]][1])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = brute_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(got) == sorted(mixing.mix(docs_of(rows).repartition(5)).collect())


def test_mixed_documents_hold_the_words_taken(spark, docs_of):
    rows = mix_rows(spark, 5, 300)
    docs = docs_of(rows)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert dict((x[0], x[1]) for x in rows)[r["doc_id"]].startswith(r["text"])
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in words.items() if v}


def test_mixing_odd_rows(docs_of, odd_rows):
    got = mixing.mix(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows) and {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(docs_of([])).collect() == []
    assert mixing.mixed_documents(docs_of(odd_rows)).count() > 0
    only_blank = docs_of([(1, None, None, None), (2, "", "en", "a")])
    assert {r["taken"] for r in mixing.mix(only_blank).collect()} == {0}
