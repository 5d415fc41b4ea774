"""Queries over the text tables (p8 to p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import abuse, leakage, mixing
from tidemark.sources.tables import read_table


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    leaks = leakage.find_leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_item"))
    return leaks.filter(F.col("coverage") >= leakage.LEAK).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks per item: documents that hold it verbatim (slots filled alike) or re-parameterised."""
    leaks = leakage.find_leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_item"))
    kind = F.when(F.col("coverage") < leakage.LEAK, "template").when(F.col("slots") < 0.5, "reparameterised").otherwise("verbatim")
    return leaks.groupBy("item_id", kind.alias("kind")).agg(F.countDistinct("doc_id").alias("documents"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The mixed blocks themselves, tokens included."""
    return mixing.mixture(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached per source."""
    return mixing.mixture(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_target"))[1]


#: Calibrated probability from which a document counts as abusive.
ABUSIVE = 0.5


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = abuse.fit(docs, read_table(spark, sf, "doc_label"))
    return abuse.score(docs, model, keep=("source",))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).filter(F.col("abuse") >= ABUSIVE).select("doc_id")


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: documents, abusive ones, their share and the mean probability."""
    d = _scored(spark, sf).groupBy("source").agg(F.count("*").alias("documents"), F.count(F.when(F.col("abuse") >= ABUSIVE, 1)).alias("abusive"), F.avg("abuse").alias("mean_probability"))
    return d.select("source", "documents", "abusive", (F.col("abusive") / F.col("documents")).alias("rate"), F.round("mean_probability", 6).alias("mean_probability"))


QUERIES = {f.__name__: f for f in (p8_found, p8_report, p9_mixture, p9_shares, p10_found, p10_scores, p10_rates)}
ORACLE: dict[str, str] = {}
