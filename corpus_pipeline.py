"""Training-data pipeline: rules, classifier, near-duplicates, mix, packed sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the rows that it keeps with the columns of documents, except the last, which
returns the packed pieces. The tokenizer's file, the library's bound on labelled rows
and the mix's weights are parameters of the operators in ``rasterloom.llm``.

All stages: texts of any length count as a whole; an empty table gives an empty result;
columns beyond those of documents are passed through whatever their names, but for
``pack``, which ignores them; rows come in any order. A ``scratch`` may be given so that
its tables can be freed when the stage's result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import minhash, mixing, packing, quality_model, quality_rules
from rasterloom.llm.common import Scratch
from rasterloom.llm.queries import tokenizer_path

#: Ids that are broadcast, at most (8 bytes each); more are joined, with the same rows.
BROADCAST_IDS = 1_000_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that pass the base rule and the adaptive fences of their language and source.

    Null and blank texts go, as they fail the base rule. Null languages and sources are
    groups of their own; repeated rows stay or go alike; a null doc_id does not matter.
    """
    return quality_rules.keep_good(docs, scratch)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that a model of all labelled documents scores 0.3 or more.

    Null and blank texts are scored by zero features; repeated rows score alike; a null
    doc_id, lang or source does not matter; without labels of both kinds all documents
    get one score.
    """
    model = quality_model.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document, of the smallest id, of each group linked by five-word shingles at 0.8.

    Null and blank texts link with nothing and stay. Of the rows of one id one stays: that
    whose text has the smallest digest, of ties that with the smallest hash of all its
    columns. Rows without an id all stay.
    """
    scratch = scratch or Scratch(spark)
    found = minhash.near_duplicates(docs, words=5, percent=80, scratch=scratch)
    gone = scratch.keep(found.where("not kept").select("doc_id").distinct(), rows=F.count(F.lit(1)))
    left = docs.join(_few(gone), "doc_id", "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    twice = scratch.keep(twice, rows=F.count(F.lit(1)))
    if not twice.seen["rows"]:
        return left.select(docs.columns)
    order = F.struct(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    one = left.join(_few(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("*"), order).alias("row")).select("row.*")
    return left.join(_few(twice), "doc_id", "left_anti").select(docs.columns).unionByName(one)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.seen["rows"] <= BROADCAST_IDS else ids


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents as often as the mix to source weights takes them.

    A null source is the last one; documents without words weigh nothing and stay, once, in
    sources that are taken whole; repeated rows are taken each for itself, and so are rows
    without an id.
    """
    return mixing.mixed_documents(docs, scratch)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    Null and empty texts are a piece of the end id alone; repeated rows and rows without an
    id are packed each for itself.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 1024, scratch=scratch)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("minhash_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Tokenising and a trained model are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input.

    What a stage wrote on its way is freed once its result is written.
    """
    results, docs, last = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with Scratch(spark) as own:
            docs = results.keep(stage(spark, docs, sf_dir, own))
        results.drop(last)
        last = docs
    return docs
