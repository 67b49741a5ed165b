"""Privacy queries on customer with derived personal-data columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy
from ..session import table
from .catalog import query

PII_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal", "email", "postcode",
               "ip_address", "passport_no", "income_band", "phone"]
TEXT_COLUMNS = ["c_name", "c_mktsegment", "email", "postcode", "ip_address", "passport_no", "phone"]

PII_SQL = """SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal,
       lower(replace(c_name, '#', '')) || '@example.org' AS email,
       lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS postcode,
       '192.0.2.' || CAST(c_custkey % 256 AS VARCHAR) AS ip_address,
       'P' || CAST(c_custkey * 7 AS VARCHAR) AS passport_no,
       CAST(floor(c_acctbal / 1000) AS BIGINT) AS income_band,
       CASE WHEN c_custkey % 3 = 0 THEN '+49 30 ' || CAST(1000000 + c_custkey AS VARCHAR) ELSE 'n/a' END AS phone
FROM customer"""


def pii_input(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal",
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.lit("@example.org")).alias("email"),
        F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("postcode"),
        F.concat(F.lit("192.0.2."), (F.col("c_custkey") % 256).cast("string")).alias("ip_address"),
        F.concat(F.lit("P"), (F.col("c_custkey") * 7).cast("string")).alias("passport_no"),
        F.floor(F.col("c_acctbal") / 1000).cast("long").alias("income_band"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+49 30 "), (F.col("c_custkey") + 1000000).cast("string")))
         .otherwise(F.lit("n/a")).alias("phone"))


def _kw(keys):
    return "|".join(keys)


def _scan_sql() -> str:
    parts = []
    for c in PII_COLUMNS:
        flags = {
            "nm": f"regexp_matches(lower('{c} '), '{_kw(privacy.NAME_KEYWORDS)}')",
            "idd": f"regexp_matches(lower('{c} '), '{_kw(privacy.ID_KEYWORDS)}')",
            "ad": f"regexp_matches(lower('{c} '), '{_kw(privacy.ADDR_KEYWORDS)}')",
            "se": f"regexp_matches(lower('{c} '), '{_kw(privacy.SENSITIVE_KEYWORDS)}')",
            "qu": f"regexp_matches(lower('{c} '), '{_kw(privacy.QUASI_ID_KEYWORDS)}')",
        }
        if c in TEXT_COLUMNS:
            pats = ", ".join(
                f"CASE WHEN count_if(regexp_matches({c}, '{p}')) > 0.3 * count({c}) AND count({c}) > 0 THEN '{n}' END"
                for n, p in privacy.PRIVACY_PATTERNS.items())
            pat_any = " OR ".join(
                f"(count_if(regexp_matches({c}, '{p}')) > 0.3 * count({c}) AND count({c}) > 0)"
                for p in privacy.PRIVACY_PATTERNS.values())
        else:
            pats, pat_any = "NULL", "false"
        sel = ", ".join(f"{v} AS {k}" for k, v in flags.items())
        src = "p" if c in TEXT_COLUMNS else "(SELECT 1) AS one"
        parts.append(f"""SELECT '{c}' AS col, {sel},
       concat_ws(', ', {pats}) AS pat_tags, ({pat_any}) AS pat_hit FROM {src}""")
    # the name rules match "<name> <label>"; with no label the text ends in a
    # space, exactly as the rules see it
    body = " UNION ALL ".join(parts)
    return f"""WITH p AS ({PII_SQL}), s AS ({body})
SELECT col AS "column", '' AS label,
       CASE WHEN pat_hit THEN 'CRITICAL' WHEN ad THEN 'WARN' WHEN nm OR idd THEN 'CRITICAL'
            WHEN se OR qu THEN 'WARN' ELSE 'OK' END AS severity,
       coalesce(nullif(concat_ws(', ', CASE WHEN nm THEN 'name' END, CASE WHEN idd THEN 'id_doc' END,
                                 CASE WHEN ad THEN 'address' END, CASE WHEN se THEN 'sensitive' END,
                                 CASE WHEN qu THEN 'quasi_id' END, nullif(pat_tags, '')), ''), 'ok') AS tags
FROM s"""


SCAN_SQL = _scan_sql()


@query("pii_scan", SCAN_SQL)
def q_pii_scan(spark, sf):
    return privacy.privacy_scan(pii_input(spark, sf))


@query("pii_pattern_scan", f"""WITH p AS ({PII_SQL})
{" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{n}' AS pattern, round(CASE WHEN count({c}) > 0 THEN count_if(regexp_matches({c}, '{pat}')) / count({c}) ELSE 0.0 END, 6) AS hit_rate FROM p" for c in TEXT_COLUMNS for n, pat in privacy.PRIVACY_PATTERNS.items())}""")
def q_pii_pattern_scan(spark, sf):
    r = privacy.pattern_hit_rates(pii_input(spark, sf))
    return r.select("column", "pattern", F.round("hit_rate", 6).alias("hit_rate"))


@query("privacy_grade", f"""WITH s AS ({SCAN_SQL})
SELECT CASE WHEN count_if(severity = 'CRITICAL') > 0 THEN 'FAIL' WHEN count_if(severity = 'WARN') > 0 THEN 'WEAK'
            ELSE 'PASS' END AS grade,
       CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS n_critical, CAST(count_if(severity = 'WARN') AS BIGINT) AS n_warn
FROM s""")
def q_privacy_grade(spark, sf):
    return privacy.privacy_grade(privacy.privacy_scan(pii_input(spark, sf)))


@query("k_anonymity", """
WITH q AS (SELECT c_nationkey, c_mktsegment, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band FROM customer),
g AS (SELECT c_nationkey, c_mktsegment, band, count(*) AS c FROM q GROUP BY ALL)
SELECT CAST(min(c) AS BIGINT) AS k, CAST(count_if(c = 1) AS BIGINT) AS n_unique_groups,
       round(100.0 * count_if(c = 1) / sum(c), 2) AS pct_unique,
       round(100.0 * sum(CASE WHEN c < 5 THEN c ELSE 0 END) / sum(c), 2) AS pct_at_risk
FROM g""")
def q_k_anonymity(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("long").alias("band"))
    return privacy.k_anonymity(c, ["c_nationkey", "c_mktsegment", "band"])


@query("pseudonymize", f"""WITH p AS ({PII_SQL})
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal, substr(sha256('tabloom-pseudonym' || passport_no), 1, 12) AS passport_no,
       income_band FROM p""")
def q_pseudonymize(spark, sf):
    df = pii_input(spark, sf)
    scan = [r.asDict() for r in privacy.privacy_scan(df).collect()]
    return privacy.pseudonymize(df, scan)


@query("privacy_audit_log", f"""SELECT CAST(1 AS BIGINT) AS dataset_id, 'scan' AS action, "column" || ':' || severity AS scope
FROM ({SCAN_SQL}) WHERE severity <> 'OK' ORDER BY scope LIMIT 200""")
def q_privacy_audit_log(spark, sf):
    """Append one audit event per flagged column to the append-only log, then
    read the latest 200 events."""
    import uuid
    from ..operators import registry
    root = registry.registry_path(spark) + f"/audit_{uuid.uuid4().hex}"
    scan = privacy.privacy_scan(pii_input(spark, sf)).where(F.col("severity") != "OK")
    events = scan.select(F.lit(1).cast("long").alias("dataset_id"), F.lit("scan").alias("action"),
                         F.concat_ws(":", "column", "severity").alias("scope"))
    registry.append_rows(events, root, "privacy_log")
    log = registry.read_table(spark, root, "privacy_log")
    return log.orderBy(F.desc("created_at"), "scope").limit(200).select("dataset_id", "action", "scope")
