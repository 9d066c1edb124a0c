"""The property graph that the fixture tables stand for, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_key, node_type, symbol_name, file_path, module_key, content_hash."""
    t = lambda n: table(spark, sf_dir, n)
    module = F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))
    place = F.concat(module, F.lit("/nation-"), F.col("n_nationkey").cast("string"))
    nation = t("nation").select("n_nationkey", module.alias("module_key"), place.alias("place"), "n_name")

    def hashed(*columns: str) -> Column:
        return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256).alias("content_hash")

    def below(df: DataFrame, nation_key: str, kind: str, own: str, name: str, node_type: str) -> DataFrame:
        path = F.concat("place", F.lit(f"/{kind}-"), F.col(own).cast("string"))
        return df.join(F.broadcast(nation), df[nation_key] == nation["n_nationkey"]).select(key(kind, own).alias("node_key"), F.lit(node_type).alias("node_type"), F.col(name).alias("symbol_name"), path.alias("file_path"), "module_key", hashed(own, name, nation_key))

    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.withColumn("name", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")))
    parts = t("part").select(key("part", "p_partkey").alias("node_key"), F.lit("table").alias("node_type"), F.col("p_name").alias("symbol_name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("module_key"), hashed("p_partkey", "p_name", "p_size"))
    own = nation.select(key("nation", "n_nationkey").alias("node_key"), F.lit("class").alias("node_type"), F.col("n_name").alias("symbol_name"), F.col("place").alias("file_path"), "module_key", hashed("n_nationkey", "n_name"))
    return (
        own.unionByName(below(t("customer"), "c_nationkey", "customer", "c_custkey", "c_name", "method"))
        .unionByName(below(t("supplier"), "s_nationkey", "supplier", "s_suppkey", "s_name", "listener"))
        .unionByName(below(orders, "c_nationkey", "order", "o_orderkey", "name", "route"))
        .unionByName(parts)
    )


def edges(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """source_key, target_key, relationship, confidence; the edges out of lineitem are combined to the most confident."""
    t = lambda n: table(spark, sf_dir, n)
    dec = "decimal(3,2)"

    def made(df: DataFrame, source: Column, target: Column, relationship: str, confidence: Column) -> DataFrame:
        return df.select(source.alias("source_key"), target.alias("target_key"), F.lit(relationship).alias("relationship"), confidence.cast(dec).alias("confidence"))

    customer, supplier, orders = t("customer"), t("supplier"), t("orders")
    out = (
        made(customer, key("nation", "c_nationkey"), key("customer", "c_custkey"), "contains", F.lit(1))
        .union(made(supplier, key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "contains", F.lit(1)))
        .union(made(customer, key("customer", "c_custkey"), key("nation", "c_nationkey"), "depends_on", F.lit(0.95)))
        .union(made(supplier, key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "depends_on", F.lit(0.95)))
        .union(made(orders, key("order", "o_orderkey"), key("customer", "o_custkey"), "calls", F.lit(0.85)))
    )
    if lines:
        sure = F.lit(1) - F.col("l_discount")
        # combined while the keys are numbers, which take less room in the shuffle than their texts
        for kind, column, relationship in (("part", "l_partkey", "uses_model"), ("supplier", "l_suppkey", "depends_on")):
            most = t("lineitem").groupBy("l_orderkey", column).agg(F.max(sure.cast(dec)).alias("sure"))
            out = out.union(made(most, key("order", "l_orderkey"), key(kind, column), relationship, F.col("sure")))
    return out


NODES_SQL = """
n as (select *, 'region-' || n_regionkey as module_key, 'region-' || n_regionkey || '/nation-' || n_nationkey as place from nation),
nodes as (
  select 'nation:' || n_nationkey as node_key, 'class' as node_type, n_name as symbol_name, place as file_path, module_key, sha256(concat_ws('|', n_nationkey, n_name)) as content_hash from n
  union all select 'customer:' || c_custkey, 'method', c_name, place || '/customer-' || c_custkey, module_key, sha256(concat_ws('|', c_custkey, c_name, c_nationkey)) from customer join n on c_nationkey = n_nationkey
  union all select 'supplier:' || s_suppkey, 'listener', s_name, place || '/supplier-' || s_suppkey, module_key, sha256(concat_ws('|', s_suppkey, s_name, s_nationkey)) from supplier join n on s_nationkey = n_nationkey
  union all select 'order:' || o_orderkey, 'route', 'order-' || o_orderkey, place || '/order-' || o_orderkey, module_key, sha256(concat_ws('|', o_orderkey, 'order-' || o_orderkey, c_nationkey)) from orders join customer on o_custkey = c_custkey join n on c_nationkey = n_nationkey
  union all select 'part:' || p_partkey, 'table', p_name, null, null, sha256(concat_ws('|', p_partkey, p_name, p_size)) from part)
"""
EDGES_SQL = """
edges as (
  select 'nation:' || c_nationkey as source_key, 'customer:' || c_custkey as target_key, 'contains' as relationship, cast(1 as decimal(3,2)) as confidence from customer
  union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', cast(1 as decimal(3,2)) from supplier
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'depends_on', cast(0.95 as decimal(3,2)) from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'depends_on', cast(0.95 as decimal(3,2)) from supplier
  union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'calls', cast(0.85 as decimal(3,2)) from orders
  union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'uses_model', max(cast(1 - l_discount as decimal(3,2))) from lineitem group by 1, 2
  union all select 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'depends_on', max(cast(1 - l_discount as decimal(3,2))) from lineitem group by 1, 2)
"""
