"""Credit-schema binding of the given star-schema tables.

The feature plan speaks the credit vocabulary: a client table, the client's
external loans (bureau), monthly loan history (bureau_balance), previous
applications, and three monthly / payment histories.  This module derives
those seven tables from the given Parquet tables with plain projections, so
every plan downstream reads real data whose size grows with the inputs:

=====================  ==========================  =========================
credit table           given table                 keys
=====================  ==========================  =========================
current_app            customer (+ nation)         SK_ID_CURR = c_custkey
bureau                 orders                      SK_ID_BUREAU = o_orderkey
bureau_balance         lineitem                    SK_ID_BUREAU = l_orderkey
previous_application   orders                      SK_ID_PREV = o_orderkey
POS_CASH_balance       events                      SK_ID_CURR = user_id
installments_payments  lineitem                    SK_ID_PREV = l_orderkey
credit_card_balance    lineitem                    SK_ID_PREV = l_orderkey
=====================  ==========================  =========================

``installments_payments`` and ``credit_card_balance`` reach the client only
through ``prev_to_client`` (orders: SK_ID_PREV -> SK_ID_CURR).  Plans either
aggregate them per SK_ID_PREV first and roll up through that bridge (cheap
at scale).

The label ``TARGET`` (negative account balance, ~8 % positives) lives in a
separate ``client_labels`` table so the scoring input never carries it.

:func:`binding_sql` returns the same derivations as SQL common table
expressions for an independent oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.sources.tables import read_table

# Day / month offsets are measured from this reference date (the
# "application date"): negative = before the application.
REFERENCE_DATE = "2000-01-01"
REFERENCE_YEAR = 2000


def _days(col: str) -> Column:
    return F.datediff(F.to_date(F.col(col)), F.lit(REFERENCE_DATE).cast("date"))


def _months(col: str) -> Column:
    return ((F.year(col) - REFERENCE_YEAR) * 12 + F.month(col) - 1).cast("int")


def current_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").alias("SK_ID_CURR"),
                    F.col("c_mktsegment").alias("NAME_SEGMENT"),
                    F.col("n_name").alias("NAME_NATION"),
                    F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Y").otherwise("N").alias("FLAG_HOUSEHOLD"),
                    F.col("n_regionkey").alias("REGION_CODE"),
                    F.col("c_nationkey").alias("NATION_CODE")))


def client_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return c.select(F.col("c_custkey").alias("SK_ID_CURR"),
                    (F.col("c_acctbal") < 0).cast("int").alias("TARGET"))


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    status = F.col("o_orderstatus")
    days_credit = _days("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderkey").alias("SK_ID_BUREAU"),
        status.alias("CREDIT_ACTIVE"),
        F.col("o_orderpriority").alias("CREDIT_TYPE"),
        days_credit.alias("DAYS_CREDIT"),
        (days_credit + 730).alias("DAYS_CREDIT_ENDDATE"),
        F.when(status == "P", F.greatest(-days_credit, F.lit(0))).otherwise(F.lit(0)).alias("CREDIT_DAY_OVERDUE"),
        F.when(status == "P", F.col("o_totalprice")).alias("AMT_CREDIT_MAX_OVERDUE"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("CNT_CREDIT_PROLONG"),
        F.col("o_totalprice").alias("AMT_CREDIT_SUM"),
        F.when(status == "F", F.lit(0.0)).when(status == "O", F.col("o_totalprice")).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(status == "P", F.col("o_totalprice")).otherwise(F.lit(0.0)).alias("AMT_CREDIT_SUM_OVERDUE"),
    )


def bureau_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"])
    status = (F.when(F.col("l_linestatus") == "F", "C")
              .when(F.col("l_returnflag") == "N", "0")
              .when(F.col("l_returnflag") == "A", "X")
              .otherwise(F.least(F.col("l_linenumber"), F.lit(5)).cast("string")))
    return li.select(F.col("l_orderkey").alias("SK_ID_BUREAU"),
                     _months("l_shipdate").alias("MONTHS_BALANCE"),
                     status.alias("STATUS"))


def previous_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    return o.select(F.col("o_orderkey").alias("SK_ID_PREV"),
                    F.col("o_custkey").alias("SK_ID_CURR"),
                    F.col("o_orderstatus").alias("NAME_CONTRACT_STATUS"),
                    F.col("o_orderpriority").alias("NAME_PRODUCT_TYPE"),
                    F.col("o_totalprice").alias("AMT_APPLICATION"),
                    _days("o_orderdate").alias("DAYS_DECISION"))


def pos_cash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return e.select(F.col("event_id").alias("SK_ID_PREV"),
                    F.col("user_id").alias("SK_ID_CURR"),
                    _months("ts").alias("MONTHS_BALANCE"),
                    F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("int").alias("CNT_INSTALMENT"),
                    F.col("value").alias("AMT_POS_VALUE"),
                    F.col("event_type").alias("NAME_CONTRACT_STATUS"))


def installments_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate"])
    return li.select(F.col("l_orderkey").alias("SK_ID_PREV"),
                     F.col("l_linenumber").alias("NUM_INSTALMENT_NUMBER"),
                     _days("l_shipdate").alias("DAYS_INSTALMENT"),
                     F.col("l_extendedprice").alias("AMT_INSTALMENT"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_PAYMENT"))


def credit_card_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    return li.select(F.col("l_orderkey").alias("SK_ID_PREV"),
                     _months("l_shipdate").alias("MONTHS_BALANCE"),
                     F.col("l_quantity").alias("AMT_DRAWINGS"),
                     F.col("l_tax").alias("RATE_TAX"),
                     F.col("l_linestatus").alias("NAME_CONTRACT_STATUS"),
                     F.col("l_returnflag").alias("NAME_RETURN_FLAG"))


def prev_to_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return o.select(F.col("o_orderkey").alias("SK_ID_PREV"), F.col("o_custkey").alias("SK_ID_CURR"))


def credit_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven input tables of the client feature plan, plus bridge and labels."""
    return {
        "current_app": current_app(spark, sf_dir),
        "bureau": bureau(spark, sf_dir),
        "bureau_balance": bureau_balance(spark, sf_dir),
        "previous_application": previous_application(spark, sf_dir),
        "POS_CASH_balance": pos_cash_balance(spark, sf_dir),
        "installments_payments": installments_payments(spark, sf_dir),
        "credit_card_balance": credit_card_balance(spark, sf_dir),
        "prev_to_client": prev_to_client(spark, sf_dir),
        "client_labels": client_labels(spark, sf_dir),
    }


# --- the same binding as SQL (oracle side) ---------------------------------

_REF = f"DATE '{REFERENCE_DATE}'"


def _sql_days(col: str) -> str:
    return f"CAST(date_diff('day', {_REF}, CAST({col} AS DATE)) AS INTEGER)"


def _sql_months(col: str) -> str:
    return f"CAST((year({col}) - {REFERENCE_YEAR}) * 12 + month({col}) - 1 AS INTEGER)"


_BINDING_SQL = {
    "current_app": f"""
        SELECT c_custkey AS SK_ID_CURR, c_mktsegment AS NAME_SEGMENT, n_name AS NAME_NATION,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Y' ELSE 'N' END AS FLAG_HOUSEHOLD,
               n_regionkey AS REGION_CODE, c_nationkey AS NATION_CODE
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "client_labels": """
        SELECT c_custkey AS SK_ID_CURR, CAST(c_acctbal < 0 AS INTEGER) AS TARGET FROM customer""",
    "bureau": f"""
        SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
               o_orderstatus AS CREDIT_ACTIVE, o_orderpriority AS CREDIT_TYPE,
               {_sql_days('o_orderdate')} AS DAYS_CREDIT,
               {_sql_days('o_orderdate')} + 730 AS DAYS_CREDIT_ENDDATE,
               CASE WHEN o_orderstatus = 'P' THEN greatest(-{_sql_days('o_orderdate')}, 0) ELSE 0 END
                   AS CREDIT_DAY_OVERDUE,
               CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS AMT_CREDIT_MAX_OVERDUE,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS CNT_CREDIT_PROLONG,
               o_totalprice AS AMT_CREDIT_SUM,
               CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE
                    WHEN o_orderstatus = 'O' THEN o_totalprice END AS AMT_CREDIT_SUM_DEBT,
               CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0.0::DOUBLE END AS AMT_CREDIT_SUM_OVERDUE
        FROM orders""",
    "bureau_balance": f"""
        SELECT l_orderkey AS SK_ID_BUREAU, {_sql_months('l_shipdate')} AS MONTHS_BALANCE,
               CASE WHEN l_linestatus = 'F' THEN 'C' WHEN l_returnflag = 'N' THEN '0'
                    WHEN l_returnflag = 'A' THEN 'X'
                    ELSE CAST(least(l_linenumber, 5) AS VARCHAR) END AS STATUS
        FROM lineitem""",
    "previous_application": f"""
        SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, o_orderstatus AS NAME_CONTRACT_STATUS,
               o_orderpriority AS NAME_PRODUCT_TYPE, o_totalprice AS AMT_APPLICATION,
               {_sql_days('o_orderdate')} AS DAYS_DECISION
        FROM orders""",
    "POS_CASH_balance": f"""
        SELECT event_id AS SK_ID_PREV, user_id AS SK_ID_CURR, {_sql_months('ts')} AS MONTHS_BALANCE,
               TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS CNT_INSTALMENT,
               value AS AMT_POS_VALUE, event_type AS NAME_CONTRACT_STATUS
        FROM events""",
    "installments_payments": f"""
        SELECT l_orderkey AS SK_ID_PREV, l_linenumber AS NUM_INSTALMENT_NUMBER,
               {_sql_days('l_shipdate')} AS DAYS_INSTALMENT, l_extendedprice AS AMT_INSTALMENT,
               l_extendedprice * (1 - l_discount) AS AMT_PAYMENT
        FROM lineitem""",
    "credit_card_balance": f"""
        SELECT l_orderkey AS SK_ID_PREV, {_sql_months('l_shipdate')} AS MONTHS_BALANCE,
               l_quantity AS AMT_DRAWINGS, l_tax AS RATE_TAX, l_linestatus AS NAME_CONTRACT_STATUS,
               l_returnflag AS NAME_RETURN_FLAG
        FROM lineitem""",
    "prev_to_client": "SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR FROM orders",
}


def binding_sql(names: list[str] | None = None) -> str:
    """``WITH`` clause defining the credit tables over the given tables."""
    names = names or list(_BINDING_SQL)
    return "WITH " + ",\n".join(f"{n} AS ({_BINDING_SQL[n]})" for n in names)


# --- declared category lists of the bound tables ------------------------------
# Domains of the generator's categorical columns; declared so that one-hot and
# count blocks have a fixed schema and need no discovery job.  The fitted
# vocabulary (operators.aggregate.fit_vocabulary) equals these on the data.

ORDER_STATUS = ["F", "O", "P"]
ORDER_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MARKET_SEGMENT = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NATION_NAMES = sorted(f"NATION_{i}" for i in range(25))
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LINE_STATUS = ["F", "O"]
RETURN_FLAG = ["A", "N", "R"]

# Loan status value that means "active".
ACTIVE_LOAN_STATUS = "O"


def binding_vocabulary() -> dict[str, dict[str, list[str]]]:
    from riskfold.constants import STATUS_CODES
    return {
        "current_app": {"NAME_SEGMENT": MARKET_SEGMENT, "NAME_NATION": NATION_NAMES,
                        "FLAG_HOUSEHOLD": ["N", "Y"]},
        "bureau": {"CREDIT_ACTIVE": ORDER_STATUS, "CREDIT_TYPE": ORDER_PRIORITY},
        "bureau_balance": {"STATUS": list(STATUS_CODES)},
        "previous_application": {"NAME_CONTRACT_STATUS": ORDER_STATUS, "NAME_PRODUCT_TYPE": ORDER_PRIORITY},
        "POS_CASH_balance": {"NAME_CONTRACT_STATUS": EVENT_TYPES},
        "installments_payments": {},
        "credit_card_balance": {"NAME_CONTRACT_STATUS": LINE_STATUS, "NAME_RETURN_FLAG": RETURN_FLAG},
    }
