"""The corpus pipeline: language, toxicity, near-duplicates, mixing, packing, each on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import language, mixing, neardup, packing, toxicity
from fathom.llm.common import bounded, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a learned language: those without letters go, and those that no language explains."""
    bounded(spark)
    samples = language.learn(language.training_rows(docs))
    found = language.identify(docs.select(*COLUMNS), samples)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("phrase_rate") < language.FOREIGN)).select(*COLUMNS)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts scored under the threshold; the network learns from the labels of documents still here."""
    labels = toxicity.training_rows(table(spark, sf_dir, "labels"))
    model = toxicity.fit(toxicity.training_rows(docs), labels)
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def by_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at five words and a similarity of 0.8: the one of least id."""
    found = neardup.near_duplicates(docs, words=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    gone = stored(gone)
    kept = docs.select(*COLUMNS).join(neardup.few(gone)(gone), "doc_id", "left_anti").select(*COLUMNS)
    # rows of one id are one document; texts are only shuffled where ids do repeat
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS)
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source's words come near its target."""
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    mixed = mixing.mix(docs, carry=tuple(c for c in COLUMNS if c != "doc_id"))
    return mixed.where("copies > 0").withColumn("copy", F.explode(copies)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("near-duplicates", by_neardup),
    ("mixture", by_mixture),
    ("packing", packed),
]

#: A recurrent network's decisions can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
