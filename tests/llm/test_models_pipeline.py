import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from rasterloom.llm import embeddings, quality_model, quality_rules  # noqa: E402
from rasterloom.llm.common import Scratch, connected_components  # noqa: E402

from .test_minhash import brute  # noqa: E402
from .test_sharding_mixing import brute_targets  # noqa: E402

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_model.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_interactions_are_learnt():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.fit(x, y)
    assert np.mean((m.score(x) > 0.5) == y) > 0.95 and any({i, j} == {0, 1} for i, j, _ in m.pairs)


def test_model_on_odd_rows(docs_of, odd_rows, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    s = quality_model.quality_scores(docs_of(odd_rows), none).collect()
    assert len(s) == len(odd_rows) and len({r["score"] for r in s}) == 1
    some = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (7, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.quality_scores(docs_of(odd_rows), some).count() == len(odd_rows)
    assert quality_model.quality_scores(docs_of([]), some).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n_links int")


def brute_vectors(rows):
    ok = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v, lab) in enumerate(ok):
        for j, w, other in ok[k + 1:]:
            if lab is not None and lab == other and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i in links}


@pytest.mark.parametrize("spread, lists", [(0.02, 1024), (0.08, 1024), (0.08, 5)])
def test_vectors_match_brute_force(spark, monkeypatch, spread, lists):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    monkeypatch.setattr(embeddings, "LISTS", lists)  # few: the second level comes in
    monkeypatch.setattr(embeddings, "PER_LIST", 16)
    r = np.random.default_rng(5)
    base = r.normal(size=(30, 24))
    rows = [(i * 2 + 1, (base[i % 30] + r.normal(size=24) * spread).astype(np.float32).tolist(), int(i % 2)) for i in range(400)]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(7)]
    got = {x[0]: (x[1], x[2], x[3]) for x in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert got == brute_vectors(rows)


def test_vectors_odd_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None),
            (None, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0, 0.0], 1)]
    got = embeddings.near_duplicates(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r["n_links"], r["component_id"]) for r in got if r["vec_id"] == 8} == {(2, 8)}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] == 9] == [(2, 8, False)]
    assert all(r["n_links"] == 0 for r in got if r["vec_id"] not in (8, 9))
    assert embeddings.near_duplicates(vectors(spark, [])).collect() == []


def test_vectors_of_any_scale(spark):
    rows = [(1, [1e200, 2e200], "a"), (2, [1e200, 2e200], "a"), (3, [2e-200, 4e-200], "a"), (4, [1.0, 2.0], "a"), (5, [2e200, -1e200], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_components_of_paths_and_stars(spark):
    e = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(e, "a long, b long"), Scratch(spark)).collect())
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 50)) and got[5001] == 5000


def brute_features(text):
    """The classifier's features of one text, word by word."""
    t = (text or "").encode()
    words = t.split()
    if not words:
        return [0.0] * len(quality_model.FEATURES)
    low = t.lower().split()
    ink = sum(map(len, words))
    share = lambda s: sum(x in s for x in t) / ink
    pairs = {(a, b) for a, b in zip(low, low[1:])} if len(low) > 1 else {tuple(low)}
    lines = [x for x in t.split(b"\n") if x.strip()]
    return [math.log2(len(words)), ink / len(words), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#*$%&<>@^~_=+\\/{}[]"), share(b"!"), share(b"|"), share(b".,;:?'\"()-"),
            sum(x >= 128 for x in t) / ink, len(set(low)) / len(words), len(pairs) / max(len(words) - 1, 1), math.log2(len(words) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1)]


def test_features_equal_plain_ones(spark, odd_rows):
    texts = [r[1] for r in odd_rows] + ["a b\nA b\n\na b!", "x|y 12 $5 \u00e9\u00e9 \u00df"] + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = quality_model.features([(t or "").encode() for t in texts])
    assert np.allclose(got, [brute_features(t) for t in texts], atol=1e-9)


def test_scores_are_sums_of_look_ups():
    r = np.random.default_rng(2)
    x = np.round(r.random((600, 4)), 2)
    m = quality_model.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    for row, p in zip(x[:50], m.score(x[:50])):
        bins = [sum(v >= c for c in cuts) for v, cuts in zip(row, m.cuts)]
        z = m.base + sum(m.single[j, k] for j, k in enumerate(bins)) + sum(t[bins[i], bins[j]] for i, j, t in m.pairs)
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-12


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, d))
        rows = before.collect()
        if name == "packing":
            break
        assert docs.columns == columns, name
        out = docs.collect()
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.quality_rules(before).where("kept").collect()}
            assert {r["doc_id"] for r in out} == want
        if name == "quality_classifier":
            model = quality_model.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
            good = model.score(np.array([brute_features(r["text"]) for r in rows])) >= 0.3
            assert sorted(map(tuple, out)) == sorted(tuple(r) for r, g in zip(rows, good) if g)
        if name == "minhash_dedup":
            assert {r["doc_id"] for r in out} == {i for i, x in brute([(r["doc_id"], r["text"]) for r in rows], 5, 80).items() if x[2]}
        if name == "mixing":
            check_mix(rows, out)
    ids = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sorted((r["doc_id"], len(ids.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in rows)
    pieces = docs.collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == tokens
    assert sum(r["length"] for r in pieces) == sum(n for _, n in tokens)
    assert max(Counter({(r["sequence_id"], r["offset"]) for r in pieces}).values()) == 1 and max(r["offset"] + r["length"] for r in pieces) <= 1024


def check_mix(rows, out):
    """Copies by an order of hashes within each source, cut at its budget, by plain sums."""
    size = {r["doc_id"]: len(words_of(r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows})
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    target = brute_targets(total)
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(words_of(r["text"]))
    for s in sources:
        left, want = math.floor(target[s]), Counter()
        order = sorted((r["doc_id"] for r in rows if r["source"] == s), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
        while left > 0 and total[s]:
            for i in order:
                take = min(size[i], left)
                want[i] += take
                left -= take
        assert {i: words[i] for i in order if words[i]} == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, docs_of, odd_rows, stage):
    name, f = corpus_pipeline.STAGES[stage]
    text = " ".join(f"word{i}" for i in range(80))
    rows = odd_rows + [(20, text, "en", "a"), (20, text, "en", "a"), (21, text + " x", "en", "a"), (22, text, None, None), (None, text, "en", "a"), (None, text, "en", "a"),
                       (30, "first text of thirty " + text[::-1], "en", "a"), (30, "second text of thirty", "en", "a")]
    docs = docs_of(rows)
    out = f(spark, docs, "/root/testdata/sf0.001").collect()
    if name == "packing":
        assert Counter(r["doc_id"] for r in out if r["start"] == 0) == Counter(r[0] for r in rows)
        return
    assert f(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    kept = Counter(r["doc_id"] for r in out)
    if name == "quality_rules":
        assert not kept[1] and not kept[2] and not kept[3] and kept[20] in (0, 2)
    if name == "minhash_dedup":
        assert kept[1] == kept[2] == kept[3] == 1 and kept[20] == 1 and not kept[21] and not kept[22] and kept[None] == 3 and kept[6] == 1 and not kept[7] and kept[30] == 1
        again = f(spark, docs.repartition(7).orderBy("n_chars"), "/root/testdata/sf0.001").collect()
        assert sorted(map(str, again)) == sorted(map(str, out))
    if name == "mixing":
        assert set(kept) <= {r[0] for r in rows} and kept[1] <= 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
