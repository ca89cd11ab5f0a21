"""Graphs over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def parts_bought_together(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, joined if some order holds both; weight: the number of such orders.

    One shuffle gathers an order's distinct parts (a short list), pairs come from the list in place,
    and pairs are counted with map-side combining. Labels and attributes come from part.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("p"))
    tails = F.transform("p", lambda x, i: F.struct(x.alias("src"), F.slice("p", i + 2, F.size("p")).alias("rest")))
    starts = orders.where(F.size("p") > 1).select(F.explode(tails).alias("t"))
    pairs = starts.select(F.col("t.src").alias("src"), F.explode("t.rest").alias("dst"))
    edges = pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    vertices = part.select(
        F.col("p_partkey").alias("vid"),
        F.char(97 + F.col("p_partkey") % 4).alias("label"),
        F.sort_array(F.array("p_brand", "p_type", F.concat(F.lit("S"), F.floor(F.col("p_size") / 10).cast("string")))).alias("attrs"),
    )
    return Graph(vertices, edges)


def customers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite edges from customers (positive ids) to nations (negative ids): one component a nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select((-1 - F.col("c_nationkey").cast("long")).alias("src"), F.col("c_custkey").alias("dst"))


def suppliers_and_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite edges from suppliers (negative ids) to the parts they delivered."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).distinct()
