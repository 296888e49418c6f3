"""A corpus from raw documents to sharded training data, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a
DataFrame; all but the last return the columns of documents. Rules for every stage:

* Null and empty texts have no words: they aren't toxic, aren't contaminated, cost no tokens,
  and are near duplicates of each other, of which the smallest id stays.
* Rows without an id are kept by the near-duplicate stage. Rows that repeat an id stay as
  they are, but for near duplicates, of which one of each group stays.
* A null source is a source of its own. A null language or length changes nothing.
* An empty table gives an empty table. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm import decontaminate, mixing, sharding, simhash, toxicity
from cueline.llm.common import materialise, private, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _beside(docs: DataFrame, added: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` of what ``step`` makes of it; those named like the added ones step aside for it."""
    low, own = {a.lower() for a in added}, private(docs)
    names = {c: f"{own}_{i}" for i, c in enumerate(docs.columns) if c.lower() in low}
    out = step(docs.withColumnsRenamed(names))
    return out.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return _beside(docs, ["score", "predicted"], lambda df: toxicity.score(df, model).where("predicted = 0"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.keep_representatives(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(docs, decontaminate.ADDED, lambda df: decontaminate.mark_contaminated(df, benchmark).where("NOT contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources: every document once at least, those of small sources repeated."""
    return _beside(docs, mixing.ADDED, lambda df: mixing.repeat_rows(mixing.mix(df, budget=None, keep_all=True)))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the slot and shard that hold them; input columns of these names are replaced."""
    return sharding.assign_shards(docs, "doc_id", sharding.shard_names())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier and the fingerprints aren't expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each writes Parquet that the next one reads.

    What a stage wrote for itself is deleted after it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = materialise(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
