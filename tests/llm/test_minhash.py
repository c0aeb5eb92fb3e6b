import random
import re

from rasterloom.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, words, percent):
    sets, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), d == find(d)) for d in ids}


def near_copies(seed, n, bases, common=0):
    """Texts with edits of a few words, and a passage that many of them share."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(common)]
    base = [[r.choice(vocab) for _ in range(r.randint(30, 90))] for _ in range(bases)]
    out = []
    for d in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((d * 3 + 1, " ".join(w[:5] + passage + w[5:])))
    return out


def result(spark, rows, words, percent=80):
    df = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
    return {r[0]: (r[1], r[2], r[3]) for r in df.collect()}


def test_matches_brute_force(spark):
    rows = near_copies(1, 260, 40)
    assert result(spark, rows, 2) == brute(rows, 2, 80)
    assert result(spark, rows, 5) == brute(rows, 5, 80)


def test_large_lists_are_dealt_out_and_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "SALT", 8)
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = near_copies(2, 200, 3, common=25)
    assert result(spark, rows, 2) == brute(rows, 2, 80)
    rows = near_copies(3, 200, 150, common=60)
    assert result(spark, rows, 2) == brute(rows, 2, 80)


def test_sketches_are_written_once_and_move_for_paired_documents_only(spark, monkeypatch):
    kept, asked, keep, mins = [], [], M.Scratch.keep, M._mins
    monkeypatch.setattr(M.Scratch, "keep", lambda self, df, **seen: (kept.append(df.columns), keep(self, df, **seen))[1])
    monkeypatch.setattr(M, "_mins", lambda ids, *a: (asked.append(ids.seen["rows"]), mins(ids, *a))[1], raising=False)
    rows = near_copies(9, 40, 5) + [(1000 + i, t) for i, t in near_copies(10, 60, 60)]
    assert result(spark, rows, 2) == brute(rows, 2, 80)
    assert sum("mins" in c for c in kept) == 1
    assert asked and max(asked) < len(rows)


def test_crowded_blocks_give_the_same_as_pairs(spark, monkeypatch):
    rows = near_copies(7, 150, 2, common=30) + [(1000 + i, t) for i, t in near_copies(8, 60, 60, common=60)]
    want = brute(rows, 2, 80)
    for crowd in (0, 1_000_000):
        monkeypatch.setattr(M, "CROWD", crowd)
        assert result(spark, rows, 2) == want


def test_short_texts_and_one_id_with_several_texts(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdef") for _ in range(r.randint(1, 12)))) for i in range(120)]
    assert result(spark, rows, 2) == brute(rows, 2, 80)
    # 3 has the texts of 7 and of 9, so all of them are one group.
    several = [(3, "a b c d"), (3, "e f g h"), (7, "a  B c d"), (9, "e f g h"), (11, "x y z")]
    got = M.near_duplicates(spark.createDataFrame(several, "doc_id long, text string"), 2).collect()
    assert sorted((x[0], x[2]) for x in got) == [(3, 3), (3, 3), (7, 3), (9, 3), (11, 11)]


def test_ids_that_are_no_numbers_link_as_they_are(spark):
    got = M.near_duplicates(spark.createDataFrame([("x", "a b c"), ("2", "a b c"), ("1", "a b c")], "doc_id string, text string"), 2).collect()
    assert sorted((r[0], r[2], r[3]) for r in got) == [("1", "1", True), ("2", "1", False), ("x", "1", False)]


def test_real_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows, 2) == brute(rows, 2, 80)


def test_odd_rows(docs_of, odd_rows):
    got = sorted(M.near_duplicates(docs_of(odd_rows), 2).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[2]["kept"] and by[3]["kept"]
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[6]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[5]["n_shingles"] == 1 and by[4]["n_shingles"] == 4


def test_empty_table(docs_of):
    assert M.near_duplicates(docs_of([]), 2).collect() == []


def test_the_filters_miss_less_than_one_in_a_million():
    from math import comb

    # At similarity 0.8 a bit of the fold differs with a probability of 0.1 at most.
    bits = 64 * M.FOLD
    most = bits - M._least(bits, 0.9)
    assert sum(comb(bits, k) * 0.1 ** k * 0.9 ** (bits - k) for k in range(most + 1, bits + 1)) < 1e-6
    t = M._least(M.KEYS, 0.8)
    assert sum(comb(M.KEYS, k) * 0.8 ** k * 0.2 ** (M.KEYS - k) for k in range(t)) < 1e-6
