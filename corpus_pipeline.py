"""From raw documents to training shards: five stages, each one operator of `quillon.llm`.

Each stage takes what the one before it kept and returns the columns of
``documents``; the last adds the place in the shards.  `run` cuts the lineage
between stages in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.decontaminate import decontaminate
from quillon.llm.frames import cut, hidden, table
from quillon.llm.minhash import near_duplicates
from quillon.llm.mixing import mix, training_rows
from quillon.llm.sharding import shard
from quillon.llm.toxicity import score, train


#: Words of a shingle of the near-duplicate stage.
SHINGLE = 2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    All columns come through unchanged, whatever their names.  Null and empty
    texts, which hold nothing toxic, are scored by the bias alone and stay where
    that is below one half; repeated rows stay or go together, rows without an id
    are scored like all others.  An empty table gives an empty result.
    """
    plain, back = hidden(docs, ["doc_id", "text"])
    model = train(plain, table(spark, sf_dir, "labels"))
    return score(plain, model).filter("predicted = 0").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least id stays.

    Two-word shingles, similarity 0.8, as operator 10 links documents.  Rows with equal id and text count once,
    and which of them stays is not defined where other columns differ; rows
    without an id are compared with nothing and stay.  Texts without words are no
    duplicates.  All columns come through unchanged, whatever their names.  An
    empty table gives an empty result.
    """
    plain, back = hidden(docs, ["doc_id", "text"])
    kept = near_duplicates(plain, shingle=SHINGLE).filter("kept and doc_id is not null").select("doc_id").distinct()
    firsts = plain.join(kept, "doc_id", "left_semi").withColumn("digest", F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "digest"]).drop("digest")
    return firsts.union(plain.filter("doc_id is null")).select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    All columns come through unchanged, whatever their names.  Null and empty
    texts hold none and stay; repeated rows and rows without an id are judged like
    all others.  An empty table gives an empty result.
    """
    plain, back = hidden(docs, ["doc_id", "text"])
    return decontaminate(plain, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Documents are taken whole: the last one of a source's demand is taken where at
    least half of it is still demanded, so a source ends within half a document
    of its target.  All columns come through unchanged, whatever their names.  Texts without words
    (null, empty) have nothing to train on and are never taken.  Equal rows and
    rows without an id are taken like all others.  An empty table gives an empty
    result.
    """
    plain, back = hidden(docs, ["doc_id", "source", "text"])
    return training_rows(mix(plain)).filter("take_words * 2 >= size").select(*back)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard, and its number in it, by a map that is stored with its next version.

    The columns of `shard` come behind those of the documents and replace columns
    of their names; all others are unchanged.  Null texts count as empty, rows
    without an id are dealt by their text, equal rows are numbered one after
    another.  An empty table gives an empty result.
    """
    return shard(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier and MinHash have no SQL; tests compare `run` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
