"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfront.llm import bpe_count, decontaminate, hilbert, langid, licenses, near_dup, packing, pii, pivot_clusters, quotes, toxicity, url_filter, whitening
from shopfront.llm.common import read
from shopfront.llm.oracle import ORACLE_SQL as ORACLE_SQL


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_count.count_tokens(read(spark, sf_dir, "documents"), vocabulary, limit=1024)


def quoting(conversations: DataFrame) -> DataFrame:
    """The conversations as people write them by mail: of three messages one quotes the message before it, and one
    the two before it, on two levels. The table itself holds no quotes."""
    said = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    marked = "regexp_replace(said, '(?m)^', '{} ')"
    one, two = (
        said.select("conv_id", (F.col("turn") + back).alias("turn"), F.expr(marked.format(">" * back)).alias(f"_{back}")) for back in (1, 2)
    )
    quoted = F.concat_ws("\n", F.when(F.col("turn") % 3 == 2, F.col("_2")), F.when(F.col("turn") % 3 > 0, F.col("_1")), "text")
    joined = conversations.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), quoted)).select(*conversations.columns)


def op3_quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(quoting(read(spark, sf_dir, "conversations")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(read(spark, sf_dir, "documents"), width=2, percent=80)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in a tree of folders made from source and id, as the table has no paths."""
    path = F.concat_ws("/", "source", *(F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100)), "doc_id")
    return licenses.scan(read(spark, sf_dir, "documents").withColumn("path", path))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages declare no canonical links and come without redirects, so the usual ones are worked out
    from their addresses."""
    pages = read(spark, sf_dir, "pages")
    rules = url_filter.rules_table(spark, url_filter.RULES)
    return url_filter.judge(pages, rules, url_filter.usual_redirects(pages))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.cluster(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_quoted_replies": op3_quoted_replies,
    "op4_language": op4_language,
    "op5_personal_data": op5_personal_data,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_nearest": op10_nearest,
    "op11_whitened": op11_whitened,
    "op12_url_filter": op12_url_filter,
    "op13_clusters": op13_clusters,
}
