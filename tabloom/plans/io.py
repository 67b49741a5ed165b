"""Source / sink / streaming queries.  Each writes a file format derived from
the given tables into a fresh folder under the shared checkpoint directory,
reads it back with the library reader and returns the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, recipe
from ..session import table
from ..sources import readers, sinks
from ..streaming import jobs
from .catalog import query, rounded
from .series import EVENTS_SQL, events_input

ORDERS_COLS_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _back(df):
    return df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus",
                     F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


@query("scan_csv", ORDERS_COLS_SQL)
def q_scan_csv(spark, sf):
    p = sinks.sink_csv(_orders(spark, sf), sinks.shared_scratch(spark, "csv"))
    return _back(readers.scan_csv(spark, p))


@query("scan_tsv", ORDERS_COLS_SQL)
def q_scan_tsv(spark, sf):
    p = sinks.sink_csv(_orders(spark, sf), sinks.shared_scratch(spark, "tsv"), "\t")
    return _back(readers.scan_tsv(spark, p))


@query("scan_txt", ORDERS_COLS_SQL)
def q_scan_txt(spark, sf):
    p = sinks.sink_csv(_orders(spark, sf), sinks.shared_scratch(spark, "txt"), ";")
    return _back(readers.scan_txt(spark, p))


@query("read_dispatch", ORDERS_COLS_SQL)
def q_read_dispatch(spark, sf):
    p = sinks.sink_csv(_orders(spark, sf), sinks.shared_scratch(spark, "dispatch"), "|")
    return _back(readers.read_dispatch(spark, p, "upload.txt"))


@query("scan_parquet", "SELECT o_orderkey, o_custkey FROM orders")
def q_scan_parquet(spark, sf):
    return readers.scan_parquet(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")


@query("scan_json_flat", """
SELECT o_orderkey, c_name AS "cust.c_name", c_mktsegment AS "cust.c_mktsegment", CAST(c_nationkey AS BIGINT) AS "cust.nation.key"
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_scan_json_flat(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    nested = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", F.struct("c_name", "c_mktsegment", F.struct(F.col("c_nationkey").alias("key")).alias("nation"))
        .alias("cust"))
    p = sinks.sink_json(nested, sinks.shared_scratch(spark, "json"))
    return readers.scan_json_flat(spark, p)


@query("scan_json_array", """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS "place.name", CAST(r_regionkey AS BIGINT) * 10 AS "place.code" FROM region""")
def q_scan_json_array(spark, sf):
    """One JSON document: a pretty-printed array of nested records."""
    record = F.struct(F.col("r_regionkey").cast("long").alias("id"), F.struct(
        F.col("r_name").alias("name"), (F.col("r_regionkey").cast("long") * 10).alias("code")).alias("place"))
    text = table(spark, sf, "region").agg(F.to_json(F.sort_array(F.collect_list(record)),
                                                    {"pretty": "true"}).alias("value"))   # five regions
    path = sinks.shared_scratch(spark, "json-array") + ".json"
    text.coalesce(1).write.mode("overwrite").text(path)
    return readers.read_dispatch(spark, path)


# The order priorities, coded 1..5 for the labelled file.
PRIORITY_LABELS = {1: "1-URGENT", 2: "2-HIGH", 3: "3-MEDIUM", 4: "4-NOT SPECIFIED", 5: "5-LOW"}


def _dta_dir(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("o_orderkey"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_totalprice")
    d = sinks.shared_scratch(spark, "dta")
    written = readers.write_dta_parts(o.repartition(4), d, {"priority": PRIORITY_LABELS},
                                      {"priority": "Order priority", "o_totalprice": "Total price"})
    written.count()
    return d


@query("scan_labelled", "SELECT o_orderkey, o_orderpriority AS priority, o_totalprice FROM orders")
def q_scan_labelled(spark, sf):
    df = readers.scan_labelled(spark, _dta_dir(spark, sf))
    h = detect.harmonize_labelled(df)
    return h.select(F.col("o_orderkey").cast("long"), "priority", "o_totalprice")


@query("extract_labels")
def q_extract_labels(spark, sf):
    return detect.extract_labels(readers.scan_labelled(spark, _dta_dir(spark, sf)))


@query("sink_csv", "SELECT count(*) AS rows FROM lineitem")
def q_sink_csv(spark, sf):
    p = sinks.sink_csv(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"),
                       sinks.shared_scratch(spark, "predictions"))
    return spark.read.option("header", True).csv(p).agg(F.count(F.lit(1)).alias("rows"))


@query("preview_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200")
def q_preview_head(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderkey").limit(200)


@query("incremental_ingest", ORDERS_COLS_SQL)
def q_incremental_ingest(spark, sf):
    src = sinks.shared_scratch(spark, "arrivals")
    o = _orders(spark, sf)
    o.repartition(4).write.parquet(src)
    out = jobs.incremental_ingest(spark, src, o.schema, sinks.shared_scratch(spark, "ingested"),
                                  sinks.shared_scratch(spark, "ingest-ckpt"))
    return out


@query("stream_profile", f"""WITH e AS ({EVENTS_SQL})
SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, count_if(value IS NULL) AS n_missing,
       round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM e GROUP BY 1, 2""")
def q_stream_profile(spark, sf):
    src = sinks.shared_scratch(spark, "events-arrivals")
    e = events_input(spark, sf)
    # six slices of January arrive, the latest days first: nothing may be too late
    day = F.dayofmonth("ts")
    for lo in range(31, -5, -6):
        e.where((day >= lo) & (day < lo + 6)).write.mode("append").parquet(src)
    out = jobs.stream_profile(spark, src, e.schema, "ts", "event_type", "value",
                              sinks.shared_scratch(spark, "events-profile"), sinks.shared_scratch(spark, "profile-ckpt"),
                              max_files_per_trigger=2)
    return rounded(out.select("event_type", "day", "n", "n_missing", "mean", "min", "max"))


DATES_SQL = """SELECT o_orderkey,
       CASE WHEN o_orderkey % 29 = 0 THEN 'not a date'
            WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
            ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date_str,
       CASE WHEN o_orderkey % 2 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS half_dates,
       o_orderstatus, o_orderdate
FROM orders"""


@query("detect_time_columns", f"""WITH d AS ({DATES_SQL}),
p AS (SELECT count_if(date_str IS NOT NULL AND length(date_str) > 0) AS n1,
             count_if(coalesce(try_strptime(date_str, '%Y-%m-%d %H:%M:%S'), try_strptime(date_str, '%Y-%m-%d'),
                               try_strptime(date_str, '%d/%m/%Y')) IS NOT NULL) AS p1,
             count_if(half_dates IS NOT NULL AND length(half_dates) > 0) AS n2,
             count_if(try_strptime(half_dates, '%Y-%m-%d') IS NOT NULL) AS p2,
             count(o_orderstatus) AS n3 FROM d)
SELECT 'o_orderkey' AS "column", false AS is_time, CAST(NULL AS DOUBLE) AS parse_rate FROM p
UNION ALL SELECT 'date_str', p1 / n1 >= 0.8, round(p1 / n1, 6) FROM p
UNION ALL SELECT 'half_dates', p2 / n2 >= 0.8, round(p2 / n2, 6) FROM p
UNION ALL SELECT 'o_orderstatus', false, 0.0 FROM p
UNION ALL SELECT 'o_orderdate', true, 1.0 FROM p""")
def q_detect_time_columns(spark, sf):
    o = table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    x = o.select("o_orderkey", F.when(k % 29 == 0, "not a date").when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
                 .when(k % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
                 .alias("date_str"),
                 F.when(k % 2 == 0, "not a date").otherwise(F.date_format(d, "yyyy-MM-dd")).alias("half_dates"),
                 "o_orderstatus", "o_orderdate")
    return rounded(detect.detect_time_columns(x))


LIKERT_SQL = """SELECT 1 + o_orderkey % 5 AS likert, o_orderstatus, o_orderpriority, o_custkey % 20 AS psu,
       CAST(year(o_orderdate) AS INTEGER) AS wave,
       CASE o_orderkey % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'neutral' ELSE 'disagree' END AS opinion
FROM orders"""


@query("detect_likert", f"""WITH d AS ({LIKERT_SQL}),
a AS (SELECT count(DISTINCT likert) AS n1, bool_and(likert = round(likert)) AS i1,
             count(DISTINCT o_orderstatus) AS n2, bool_or(regexp_matches(lower(o_orderstatus), '{detect.LIKERT_PATTERN}')) AS k2,
             count(DISTINCT o_orderpriority) AS n3, bool_or(regexp_matches(lower(o_orderpriority), '{detect.LIKERT_PATTERN}')) AS k3,
             count(DISTINCT psu) AS n4, bool_and(psu = round(psu)) AS i4,
             count(DISTINCT wave) AS n5, bool_and(wave = round(wave)) AS i5,
             count(DISTINCT opinion) AS n6, bool_or(regexp_matches(lower(opinion), '{detect.LIKERT_PATTERN}')) AS k6 FROM d)
SELECT 'likert' AS "column", CAST(n1 AS BIGINT) AS n_levels, n1 BETWEEN 3 AND 7 AND i1 AS is_likert FROM a
UNION ALL SELECT 'o_orderstatus', n2, n2 BETWEEN 3 AND 7 AND (k2 OR n2 IN (5, 7)) FROM a
UNION ALL SELECT 'o_orderpriority', n3, n3 BETWEEN 3 AND 7 AND (k3 OR n3 IN (5, 7)) FROM a
UNION ALL SELECT 'psu', n4, n4 BETWEEN 3 AND 7 AND i4 FROM a
UNION ALL SELECT 'wave', n5, n5 BETWEEN 3 AND 7 AND i5 FROM a
UNION ALL SELECT 'opinion', n6, n6 BETWEEN 3 AND 7 AND (k6 OR n6 IN (5, 7)) FROM a""")
def q_detect_likert(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    x = o.select((1 + k % 5).alias("likert"), "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 20).alias("psu"),
                 F.year("o_orderdate").alias("wave"),
                 F.when(k % 3 == 0, "agree").when(k % 3 == 1, "neutral").otherwise("disagree").alias("opinion"))
    return detect.detect_likert(x, x.columns)


@query("filter_complete_cases", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS pr,
                  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS tp FROM orders)
SELECT * FROM t WHERE pr IS NOT NULL AND tp IS NOT NULL""")
def q_filter_complete_cases(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    t = o.select("o_orderkey", F.when(k % 23 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("pr"),
                 F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("tp"))
    return t.na.drop("any")


@query("drop_high_na_50", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_totalprice END AS sparse,
                  CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE o_orderstatus END AS half FROM orders)
SELECT o_orderkey, half FROM t""")
def q_drop_high_na_50(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    t = o.select("o_orderkey", F.when(k % 10 < 7, F.lit(None)).otherwise(F.col("o_totalprice")).alias("sparse"),
                 F.when(k % 10 < 4, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("half"))
    return recipe.drop_high_missing(t, 0.5)


@query("detect_implicates", """
SELECT 'long' AS kind, 'implicate' AS "column", CAST(count(DISTINCT imp) AS BIGINT) AS m FROM orders, range(1, 6) AS t(imp)""")
def q_detect_implicates(spark, sf):
    from .survey import mi_input
    info = detect.detect_implicates(mi_input(spark, sf))
    return spark.createDataFrame([(info["kind"], info.get("column"), int(info["m"]))], "kind string, column string, m long")
