"""Inputs derived from the given tables, each written twice: as DataFrame code
and as the identical SQL the DuckDB oracle runs.  NULLs and special columns
are injected by deterministic formulas on keys, never by sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# --------------------------------------------------------------------------
# profile input: orders joined to customer, with injected missing values, a
# constant, a quasi-constant, an id-like string, a sparse and a skewed column.
# (name, R class, is_numeric)
PROFILE_COLUMNS = [
    ("o_orderkey", "integer", True),
    ("o_orderstatus", "character", False),
    ("o_totalprice", "numeric", True),
    ("o_orderdate", "POSIXct/POSIXt", False),
    ("o_orderpriority", "character", False),
    ("order_code", "character", False),
    ("c_nationkey", "integer", True),
    ("c_acctbal", "numeric", True),
    ("c_mktsegment", "character", False),
    ("const_one", "integer", True),
    ("rare_flag", "integer", True),
    ("sparse_tax", "numeric", True),
    ("skewed", "numeric", True),
    ("value_missing", "numeric", True),
]


def profile_input(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        F.when(F.col("o_orderkey") % 23 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_code"),
        "c_nationkey", "c_acctbal", "c_mktsegment",
        F.lit(1).alias("const_one"),
        F.when(F.col("o_orderkey") % 5000 == 0, 1).otherwise(0).alias("rare_flag"),
        F.when(F.col("o_orderkey") % 10 < 7, F.lit(None)).otherwise(F.col("o_totalprice") / 1000.0).alias("sparse_tax"),
        F.exp(F.col("c_acctbal") / 2000.0).alias("skewed"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / 100.0).alias("value_missing"),
    )


PROFILE_INPUT_SQL = """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       'ORD-' || CAST(o_orderkey AS VARCHAR) AS order_code,
       c_nationkey, c_acctbal, c_mktsegment,
       1 AS const_one,
       CASE WHEN o_orderkey % 5000 = 0 THEN 1 ELSE 0 END AS rare_flag,
       CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_totalprice / 1000.0 END AS sparse_tax,
       exp(c_acctbal / 2000.0) AS skewed,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 100.0 END AS value_missing
FROM orders JOIN customer ON o_custkey = c_custkey
"""

# --------------------------------------------------------------------------
# numeric lineitem frame for correlations / leakage: includes a leak column.
LINE_NUM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "leak_price", "skewed_qty"]


def line_numeric(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     (2 * F.col("l_extendedprice") + 1).alias("leak_price"),
                     F.exp(F.col("l_quantity") / 10.0).alias("skewed_qty"),
                     "l_returnflag", "l_linestatus")


LINE_NUMERIC_SQL = """
SELECT l_quantity, l_extendedprice, l_discount, l_tax,
       2 * l_extendedprice + 1 AS leak_price,
       exp(l_quantity / 10.0) AS skewed_qty,
       l_returnflag, l_linestatus
FROM lineitem
"""

# --------------------------------------------------------------------------
# recipe input: orders with NULLs, zeros, negatives and rare levels.
def recipe_input(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        F.when(k % 23 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / 1000.0).alias("price_k"),
        F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("o_custkey") % 7).alias("cust_mod"),
        ((k % 11) - 5).alias("disc"),
        F.when(k % 200 == 0, F.concat(F.lit("RARE-"), (k % 3).cast("string")))
         .otherwise(F.col("o_orderstatus")).alias("status_r"),
    )


RECIPE_INPUT_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 1000.0 END AS price_k,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey % 7 END AS cust_mod,
       (o_orderkey % 11) - 5 AS disc,
       CASE WHEN o_orderkey % 200 = 0 THEN 'RARE-' || CAST(o_orderkey % 3 AS VARCHAR) ELSE o_orderstatus END AS status_r
FROM orders
"""


# date strings in three formats by key, garbage for every 29th key
def date_strings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    s = (F.when(k % 29 == 0, F.lit("not a date"))
         .when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
         .when(k % 3 == 1, F.date_format(d, "dd/MM/yyyy"))
         .otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss")))
    return o.select("o_orderkey", s.alias("date_str"))


DATE_STRINGS_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 29 = 0 THEN 'not a date'
            WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
            ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date_str
FROM orders
"""
