import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from rasterloom.llm import packing as P  # noqa: E402
from rasterloom.llm import pieces, tokens  # noqa: E402

ODD = ["", "  ", "don't 'tis we'll I'M they've 'd'd ''s !'s x'", "<|endoftext|>hi<|startoftext|> there", "İstanbul Σίσυφος", "école naïve ÀÉ", "a1b22c333 ½²",
       "日本語テキスト", "emoji 😀 👨‍👩‍👧", "\x1c\x1d a \x85b c", "it's<|endoftext|>'s", "a" * 300, " lead   trail  \n\n x",
       # Newer than some versions of Unicode: a capital letter, letters, combining marks, a number.
       "ß\u0663\u0668\u0647the\x1c!!\u1c89's", "a\u1c89B \U000105c0\U000105c1x \ua7cb\ua7cc", "a\u0898\u0323b a\u0323\u0898", "q\u0323\u0307 q\u0307\u0323 \U00010d40\U00010d41",
       "x\U00016d40\U00016d70 \U0001fae9 \U00013460"]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(spark, texts):
    path = public.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokens.token_counts(df, path, 100).collect()}
    for i, t in enumerate(texts):
        want = len(lib.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len(t.encode()), want > 100), t[:40]
        if want > 100 and "<|" not in t:
            k = got[i]["limit_chars"]
            assert len(lib.encode(t[:k], add_special_tokens=False).ids) <= 100 < len(lib.encode(t[:k + 1], add_special_tokens=False).ids)


def test_texts_of_any_code_points(spark):
    r = random.Random(11)
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x600), (0x880, 0x8F0), (0x1AB0, 0x1B00), (0x1C80, 0x1CC8), (0x2000, 0x2070), (0xA7C0, 0xA800), (0x10580, 0x10600), (0x10D40, 0x10D90), (0x1FA70, 0x1FB00), (0xE0000, 0xE0100)]
    odd = ["".join(chr(r.randrange(*r.choice(blocks))) for _ in range(r.randint(1, 12))) for _ in range(6000)]
    path, byte = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    got = {x["doc_id"]: x["n_tokens"] for x in tokens.token_counts(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path).collect()}
    assert [got[i] for i in range(len(odd))] == [len(e.ids) for e in lib.encode_batch(odd, add_special_tokens=False)]
    lib = tokenizers.Tokenizer.from_file(byte)
    assert [x.tolist() for x in P.encoder(byte).encode(odd)] == [e.ids for e in lib.encode_batch(odd, add_special_tokens=False)]


def test_every_prefix(texts):
    path = public.path("word_bpe_49k.json")
    lib, pc = tokenizers.Tokenizer.from_file(path), tokens.counter(path)
    for t in texts[2:30]:
        t = t[:150]
        if "<|" in t or "İ" in t or pieces._nfc(t) != t:  # the prefixes are of the NFC text
            continue
        base = 0
        for c in pieces.chunks([t], "dropped", pc.specials):
            for j in range(len(c.start)):
                for k, n in enumerate(pc.table(c.piece(j)), 1):
                    prefix = t[:c.offset[j] + c.start[j] + k]
                    assert len(lib.encode(prefix, add_special_tokens=False).ids) == base + n
                base += pc.count(c.piece(j))


def test_stored_tables_answer_budgets(spark, texts):
    path = public.path("word_bpe_49k.json")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in tokens.tokens_within(tokens.prefix_tables(df, path), 40).collect():
        assert r["fit_tokens"] <= 40


def test_blocks_of_long_texts_change_nothing(monkeypatch, texts):
    enc = P.encoder(public.path("byte_bpe_50k.json"))
    whole = [x.tolist() for x in enc.encode(texts)]
    monkeypatch.setattr(pieces, "CHUNK", 64)
    assert [x.tolist() for x in enc.encode(texts)] == whole
    lib = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert whole == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, texts, path):
    lib = tokenizers.Tokenizer.from_file(path)
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts.items():
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return sum(r["length"] for r in rows) / (1024 * len(seqs))


def test_packing_is_whole_and_dense(spark, texts):
    path = public.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert check_packing(P.pack(df, path).collect(), dict(enumerate(texts)), path) > 0.95


def test_plan_uses_up_any_histogram():
    r = random.Random(3)
    for _ in range(5):
        h = np.array([0, *(r.choice([0, 0, r.randint(0, 40)]) for _ in range(P.UNITS))])
        left = h.copy()
        for combo, n in P.plan(h):
            assert sum(combo) <= P.UNITS and n > 0
            for u in combo:
                left[u] -= n
        assert not left.any()


def test_odd_rows(docs_of, odd_rows):
    path = public.path("byte_bpe_50k.json")
    rows = P.pack(docs_of(odd_rows), path).collect()
    assert {r["doc_id"] for r in rows} == {x[0] for x in odd_rows}
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    counts = tokens.token_counts(docs_of(odd_rows), public.path("word_bpe_49k.json")).collect()
    assert len(counts) == len(odd_rows) and {r["n_tokens"] for r in counts if r["doc_id"] in (1, 2, 3)} == {0}
    assert P.pack(docs_of([]), path).collect() == [] and tokens.token_counts(docs_of([]), public.path("word_bpe_49k.json")).collect() == []
