import hashlib
import random

import numpy as np
import pytest

from rasterloom.llm import suffixes


def plain(rows, length):
    """Removed bytes of every (id, text) by comparing all strings with all earlier ones."""
    texts = sorted({(i is None, i, (t or "").encode()) for i, t in rows}, key=lambda x: (x[0], x[1] or 0, hashlib.md5(x[2]).hexdigest()))
    seen, out = set(), {}
    for none, i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p:p + length] in seen:
                gone[p:p + length] = True
            seen.add(b[p:p + length])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i, hashlib.md5(b).hexdigest()] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((repr(i), *out[i, hashlib.md5((t or "").encode()).hexdigest()]) for i, t in rows)


def found(spark, rows, length, kind="long", parts=3):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], f"doc_id {kind}, text string, spans string, kept int").repartition(parts)
    return sorted((repr(r["doc_id"]), *list(r)[1:]) for r in suffixes.digests(suffixes.deduplicated(df, length)).collect())


def corpus(seed, n=40):
    r = random.Random(seed)
    words = ["ab", "ba", "aab", "ü", "x", " ", "\0", "long", "word", "s"]
    passages = ["".join(r.choice(words) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = "".join(r.choice(words) for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            k = r.randint(0, len(p))
            t += p[k // 2:k] + r.choice(words) + p * r.choice([0, 1, 1, 2])
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed,length", [(1, 20), (2, 100), (3, 2), (4, 33)])
def test_equals_plain_search(spark, seed, length):
    rows = corpus(seed)
    rows += [(100, rows[3][1]), (101, "ab" * 400), (102, "a" * 500), (103, "b" + "a" * 499), (104, rows[5][1][7:] + "tail"), (105, None), (106, "")]
    assert found(spark, rows, length) == plain(rows, length)


def test_odd_tables(spark, odd_rows, docs_of):
    rows = [(i, t) for i, t, *_ in odd_rows if t is None or len(t) < 5000] + [(9, "q" * 300), (9, "q" * 300), (9, "r" * 150 + "q" * 120), (None, "q" * 130), (None, "z" * 130)]
    assert found(spark, rows, 50) == plain(rows, 50)
    assert found(spark, rows, 50, parts=1) == plain(rows, 50)
    assert found(spark, [], 50) == []
    out = {r["doc_id"]: r for r in suffixes.digests(suffixes.deduplicated(docs_of(odd_rows), 100)).collect()}
    assert out[4]["n_removed"] == 460_000 - 23 and out[4]["n_spans"] == 1


def test_text_ids(spark):
    rows = [("a", "w" * 30 + "xyz" * 40), ("b", "xyz" * 40), ("c", "short"), (None, "w" * 30 + "xyz")]
    got = {r[0]: r[1:] for r in found(spark, rows, 25, "string")}
    assert got["'b'"][1] == 120 and got["'a'"][0] == 150 and got["'c'"][1] == 0 and got["None"][1] == 33


def test_widespread_line(spark):
    """A line with other words around it in every text makes one name of many runs; no class may hold them all."""
    r = random.Random(5)
    line = "".join(r.choice("abcdefgh ") for _ in range(70))
    rows = [(i, f"{i * 7919:09d}"[::-1] + line + str(i)) for i in range(1500)]
    rows += [(2000, rows[0][1][3:] + "!"), (2001, rows[700][1])]
    assert found(spark, rows, 60, parts=2) == plain(rows, 60)
    assert found(spark, rows, 60, parts=2)[0][2] == 0


def test_longest_texts_cross_the_chunks(spark):
    r = np.random.default_rng(3)
    body = "".join(map(chr, r.integers(97, 123, 300_000)))
    rows = [(1, body), (2, body[131_000:131_200] + "-" + body[262_000:262_144 + 300]), (3, "+" + body)]
    assert found(spark, rows, 100) == plain(rows, 100)
