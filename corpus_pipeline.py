"""A training-data pipeline over ``documents``: each stage is one operator on all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return rows with the documents' columns, the last one pieces of token sequences.
What a stage writes to the shared folder for itself goes when the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import exact_dedup, jaccard, mixing, packing, quality, storage

#: Near duplicates share five-word shingles and have a similarity of 0.8 or more.
NEAR_SHINGLE, NEAR_THRESHOLD = 5, 80

_left: list[storage.Workspace] = []


def _workspace(spark: SparkSession, name: str) -> storage.Workspace:
    while _left:
        old = _left.pop()
        if old.spark is spark:
            old.drop()
    work = storage.Workspace(spark, f"pipeline-{name}")
    _left.append(work)
    return work


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects, those with a score under 0.3.

    Null and empty texts are scored as texts without terms, long ones whole, repeated rows each alike. Rows with a null
    id are scored, and not learned from. A column called score stays. An empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = storage.free_name(docs.columns, "score")
    return quality.scored(docs, model, column=score).where(F.col(score) >= quality.KEEP_FROM).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the smallest id.

    A null text is equal to an empty one; a null id comes last; of rows alike one stays. Texts are compared whole.
    Further columns stay, whatever their names.
    """
    return exact_dedup.exact_dedup(docs, _workspace(spark, "exact"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near duplicates, keep the row with the smallest id.

    Null and empty texts have no shingles and are near nothing: all of them stay. Of ties in the id, null ids included,
    one row stays. Texts are compared whole. Further columns stay, whatever their names.
    """
    return jaccard.near_dedup(docs, _workspace(spark, "near"), NEAR_SHINGLE, NEAR_THRESHOLD)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; one that isn't taken goes.

    A null source is a source of its own. Null and empty texts have no words and follow their source's whole
    repetitions. Rows alike are each mixed. Further columns stay, whatever their names.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("doc"))
    mixed = mixing.mix(whole, _workspace(spark, "mixing"), keep=["doc"])
    return mixed.select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc")).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents, repeats included, into sequences of 4096 tokens: a row for each piece.

    A null or empty text is one end id; only texts of over 4096 tokens are cut. Null ids stay null. Other columns go.
    """
    return packing.pack(docs, work=_workspace(spark, "packing"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = storage.Workspace(spark, "stages")
    for i, (_, stage) in enumerate(STAGES):
        docs = kept.table(stage(spark, docs, sf_dir), str(i))
        if i:
            kept.drop(str(i - 1))
    return docs
