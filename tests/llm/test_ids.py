"""Ids of types other than whole numbers: nothing is lost, nothing fails."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import embeddings, minhash, packing, quality_model, tokens
from rasterloom.llm.queries import tokenizer_path

TEXT = "one two three four five six seven eight nine ten "


def docs(spark):
    rows = [("b", TEXT * 3), ("a", TEXT * 3), ("B", "other words alone in here"), (None, TEXT * 3), ("7", TEXT * 3 + "x"), ("c", None)]
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_near_duplicates(spark):
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark), words=2).collect()}
    assert got == {"b": ("7", False), "a": ("7", False), "7": ("7", True), "B": ("B", True), None: (None, True), "c": ("c", True)}


def test_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([("b", v, "x"), ("a", v, "x"), ("c", [-1.0, 0.0, 1.0], "x"), ("d", v, "y"), (None, v, "x")], "vec_id string, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {"b": (1, "a", False), "a": (1, "a", True), "c": (0, "c", True), "d": (0, "d", True), None: (0, None, True)}


def test_tokens_and_pieces(spark):
    assert {r["doc_id"] for r in tokens.token_counts(docs(spark), tokenizer_path("word_bpe_49k.json")).collect()} == {"b", "a", "B", None, "7", "c"}
    packed = packing.pack(docs(spark), tokenizer_path("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in packed.collect()} == {"b", "a", "B", None, "7", "c"} and dict(packed.dtypes)["doc_id"] == "string"


def test_quality(spark):
    labels = spark.createDataFrame([(f"k{i}", i % 2) for i in range(40)], "doc_id string, quality int")
    rows = spark.createDataFrame([(f"k{i}", TEXT * 4 if i % 2 else "# # $ %" * 9) for i in range(40)] + [("k1", "twice"), (None, TEXT)], "doc_id string, text string")
    got = quality_model.quality_scores(rows, labels).collect()
    assert len(got) == 42 and all(0 <= r["score"] <= 1 for r in got)
    again = {(r["doc_id"], r["score"]) for r in quality_model.quality_scores(rows.repartition(7, F.rand(1)), labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}


def test_many_equal_pieces_without_ids_share_no_bucket(spark):
    """A third of all rows alike: their pieces lie in many buckets, each piece is placed once."""
    df = spark.createDataFrame([(None, "the same short text")] * 300 + [(i, TEXT * (i % 5)) for i in range(600)], "doc_id long, text string").repartition(4)
    got = packing.pack(df, tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(got) == 900 and len({(r["sequence_id"], r["offset"]) for r in got}) == 900
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert [p for p, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1].tolist()] and sum(n for _, n in pieces) <= 1024
