"""Sentences derived from the star-schema tables, so that cue-driven operators have input: (doc_id, sent_idx, sentence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per order; the document is its customer."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    priority = F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))
    sentence = F.concat(F.lit("The order of the "), F.col("c_mktsegment"), F.lit(" segment was placed on "), F.date_format("o_orderdate", "MMMM d"), F.lit(" with "), priority, F.lit(" priority."))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return joined.select(F.col("o_custkey").alias("doc_id"), place.alias("sent_idx"), sentence.alias("sentence"))


def region_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with lists, a parenthesis, a name and a dash, for each region."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    joined = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    name = F.initcap(F.lower(F.col("r_name")))
    listed = F.concat(F.array_join(F.slice("n", 1, 2), ", "), F.lit(" and "), F.get("n", F.lit(2)))
    forms = (
        F.concat(F.lit("The region has nations such as "), listed, F.lit(".")),
        F.concat(F.lit("Trade covers many goods including steel, "), F.lower(F.get("n", F.lit(0))), F.lit(" timber, wool in "), name, F.lit(".")),
        F.concat(F.lit("Ports of the coast ("), name, F.lit(" Port) are busy all year long.")),
        F.concat(F.lit("The market is widely known as "), name, F.lit(" exchange floor, or the pit.")),
        F.concat(F.lit("Customs stay low - free "), name, F.lit(" harbour rules. They were set in 1984 and cut 12.5% in March 2019.")),
    )
    return joined.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.posexplode(F.array(*forms)).alias("sent_idx", "sentence"))


def bullet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer with a heading, bullets and list labels."""
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Accounts of "), F.col("c_name"), F.lit(" • a) open balance "), F.col("c_acctbal").cast("int").cast("string"), F.lit(" • 1. Segment "), F.col("c_mktsegment"), F.lit(" 2.▪ last – point\n\nNo bullets here. Dr. X. Y. Smith vs. "), F.col("c_name"), F.lit(" wins. And so on."))
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region facts under negative document numbers, and order facts."""
    regions = region_facts(spark, sf_dir).withColumn("doc_id", -1 - F.col("doc_id"))
    return regions.unionByName(order_facts(spark, sf_dir).withColumn("sent_idx", F.col("sent_idx").cast("int")))
