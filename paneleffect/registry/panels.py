"""Panels derived from the given tables, in Spark and as SQL text.

dense: customer nation × supplier region × week. fine: customer × supplier × week. events: one
row per user and day. raw: the fine panel with text metrics and missing ids, times and values, for
the checks. long: the dense panel with one row per suggestion/action/outcome type. predictions:
plain arithmetic on the long panel in place of model output, so the table operators can be checked.

The dense, fine and long panels are computed once per session and input folder and written as
parquet to the shared folder, since that is how a panel reaches the operators: as a stored table.
"""

from __future__ import annotations

from functools import cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneleffect.config import Roles
from paneleffect.functions.skew import shared_folder

DENSE_ROLES = Roles(
    ("suggestion_email", "suggestion_call"),
    ("action_email", "action_call"),
    ("trx", "nbrx"),
    "week_end_date",
    "hcp_id",
    "rep_id",
)
EVENT_ROLES = Roles(("suggestion_view",), ("action_click",), ("outcome_trx",), "event_date", "hcp_id", "rep_id")
KEYS = ("hcp_id", "rep_id", "week_end_date")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hits(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the customer's nation and the supplier's region."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    order = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    # 25 nations, whatever the scale.
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"))
    # Orders get their week and their customer before they meet the lines, of which there are several to an order.
    week = F.date_add(F.date_trunc("week", "o_orderdate").cast("date"), 6).alias("week_end_date")
    placed = order.select("o_orderkey", "o_custkey", "o_orderpriority", week).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    supplied = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return line.join(supplied, F.col("l_suppkey") == F.col("s_suppkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def _metrics() -> dict[str, Column]:
    return {
        "suggestion_email": _hits(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
        "suggestion_call": _hits(F.col("o_orderpriority") == "3-MEDIUM"),
        "action_email": _hits(F.col("l_returnflag") == "A"),
        "action_call": _hits(F.col("l_returnflag") == "R"),
        "trx": F.sum("l_quantity"),
        "nbrx": F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)),
    }


def build_dense(spark: SparkSession, sf: str) -> DataFrame:
    keyed = lines(spark, sf).withColumns(
        {
            "hcp_id": F.concat(F.lit("H"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")),
            "rep_id": F.concat(F.lit("R"), F.col("n_regionkey").cast("string")),
        }
    )
    return keyed.groupBy(*KEYS).agg(*[v.alias(k) for k, v in _metrics().items()])


def build_fine(spark: SparkSession, sf: str) -> DataFrame:
    keyed = lines(spark, sf).withColumns({"hcp_id": F.col("o_custkey"), "rep_id": F.col("l_suppkey")})
    return keyed.groupBy(*KEYS).agg(*[v.alias(k) for k, v in _metrics().items()])


@cache
def _store(app: str, spark: SparkSession, sf: str, name: str) -> str:
    place = f"{shared_folder(spark)}/panel-{name}-{uuid4().hex}"
    BUILDERS[name](spark, sf).write.parquet(place)
    return place


def stored(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(_store(spark.sparkContext.applicationId, spark, sf, name))


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "dense")


def fine(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "fine")


def long(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "long")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """The dense panel as it might arrive: text numbers, unreadable and missing cells."""
    d = dense(spark, sf)
    week = F.date_format("week_end_date", "yyyy-MM-dd")
    return d.select(
        F.when(F.col("trx") % 17 == 0, None).otherwise(F.col("hcp_id")).alias("hcp_id"),
        "rep_id",
        F.when(F.col("trx") % 29 == 0, "not a date").otherwise(week).alias("week_end_date"),
        F.when(F.col("suggestion_email") % 5 == 4, "bad")
        .when(F.col("suggestion_email") % 5 == 3, None)
        .otherwise(F.concat(F.lit(" "), F.col("suggestion_email").cast("string")))
        .alias("suggestion_email"),
        "suggestion_call",
        "action_email",
        "action_call",
        F.when(F.col("trx") % 3 == 0, None).otherwise(F.col("trx")).alias("trx"),
        "nbrx",
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.groupBy(
        F.col("user_id").alias("hcp_id"), (F.col("user_id") % 5).alias("rep_id"), F.col("ts").cast("date").alias("event_date")
    ).agg(
        _hits(kind == "view").alias("suggestion_view"),
        _hits(kind == "click").alias("action_click"),
        F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0.0)).alias("outcome_trx"),
    )


def build_long(spark: SparkSession, sf: str) -> DataFrame:
    """One row per rep × customer × week × (suggestion, action, outcome) type.

    Means are rounded, so that equal ones are equal whatever order their values were added in. The lines are read and joined
    once: totals per nation, region, week and segment first, then names, the panel's totals and the most frequent segment from those few rows."""
    keys = ["rep_id", "customer_id", "week_end_date"]
    suggested = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    totals = {
        **_metrics(),
        "theme_f_qualified": _hits(suggested & (F.col("l_linestatus") == "F")),
        "theme_o_qualified": _hits(suggested & (F.col("l_linestatus") == "O")),
        "covariate_path_b_lines": F.count(F.lit(1)),
        **{f"_sum_{c}": F.sum(c) for c in ("s_acctbal", "c_acctbal")},
        **{f"_count_{c}": F.count(c) for c in ("s_acctbal", "c_acctbal")},
    }
    by_segment = (
        lines(spark, sf)
        .groupBy("n_regionkey", "c_nationkey", "week_end_date", "c_mktsegment")
        .agg(*[v.alias(k) for k, v in totals.items()])
        .withColumns(
            {
                "customer_id": F.concat(F.lit("H"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")),
                "rep_id": F.concat(F.lit("R"), F.col("n_regionkey").cast("string")),
            }
        )
    )

    def mean(c: str) -> Column:
        return F.round(F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_count_{c}")), 9)

    # The most frequent segment, ties by name.
    best = F.min(F.struct((-F.col("covariate_path_b_lines")).alias("m"), F.col("c_mktsegment").alias("s")))["s"]
    wide = by_segment.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _metrics()],
        mean("s_acctbal").alias("confound_path_a_suppbal"),
        mean("c_acctbal").alias("confound_path_b_custbal"),
        *[F.sum(c).cast("double").alias(c) for c in ("theme_f_qualified", "theme_o_qualified", "covariate_path_b_lines")],
        best.alias("covariate_path_a_segment"),
    )
    channels = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("suggestion_type"),
                    F.lit(c).alias("action_type"),
                    F.lit(o).alias("outcome_type"),
                    F.col(f"suggestion_{c}").cast("double").alias("suggestion_count"),
                    F.col(f"action_{c}").cast("double").alias("action_count"),
                    F.col(o).cast("double").alias("outcome_count"),
                )
                for c in ("email", "call")
                for o in ("trx", "nbrx")
            ]
        )
    ).alias("m")
    rest = [
        "confound_path_a_suppbal",
        "confound_path_b_custbal",
        "covariate_path_a_segment",
        "covariate_path_b_lines",
        "theme_f_qualified",
        "theme_o_qualified",
    ]
    return wide.select(*keys, channels, *rest).select(*keys, "m.*", *rest)


BUILDERS = {"dense": build_dense, "fine": build_fine, "long": build_long}


def path_a_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Path A grain: rep × customer × week, calls on the total-outcome rows."""
    d = long(spark, sf)
    return d.where((F.col("suggestion_type") == "call") & (F.col("action_type") == "call") & (F.col("outcome_type") == "trx"))


def actions_factual(spark: SparkSession, sf: str) -> DataFrame:
    a = path_a_panel(spark, sf)
    return a.withColumns(
        {
            "prediction": F.when(F.col("action_count") < 9, F.col("action_count") * 0.75 + F.col("suggestion_count") * 0.5 - 1.0),
            "propensity_a": F.col("suggestion_count") * 0.25,
        }
    )


def actions_counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    return path_a_panel(spark, sf).withColumn("prediction", F.col("action_count") * 0.75 - 1.0)


def outcomes_factual(spark: SparkSession, sf: str) -> DataFrame:
    """Customer × week × outcome type; calls."""
    d = long(spark, sf).where((F.col("suggestion_type") == "call") & (F.col("action_type") == "call"))
    b = d.groupBy("customer_id", "week_end_date", "outcome_type").agg(
        F.sum("action_count").alias("action_count"),
        F.sum("suggestion_count").alias("suggestion_count"),
        F.sum("outcome_count").alias("outcome_count"),
    )
    return b.withColumns(
        {
            "prediction": F.col("outcome_count") * 0.5 + F.col("action_count") * 0.25 - 20.0,
            "propensity_b": F.col("action_count") * 0.125,
        }
    )


def outcomes_counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes_factual(spark, sf).withColumn("prediction", F.col("outcome_count") * 0.5 - 20.0)


_LINES = """
lines AS (
  SELECT l_quantity, l_returnflag, l_linestatus, o_orderpriority, o_custkey, l_suppkey, c_acctbal, c_mktsegment, s_acctbal,
         c_nationkey, n_regionkey, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_end_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""
_METRICS = """
  CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS suggestion_email,
  CAST(SUM(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS suggestion_call,
  CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS action_email,
  CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS action_call,
  SUM(l_quantity) AS trx,
  SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS nbrx
"""
_NAMES = "'H' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')", "'R' || CAST(n_regionkey AS VARCHAR)"
DENSE = f"{_LINES}, dense AS (SELECT {_NAMES[0]} AS hcp_id, {_NAMES[1]} AS rep_id, week_end_date, {_METRICS} FROM lines GROUP BY 1, 2, 3)"
FINE = f"{_LINES}, fine AS (SELECT o_custkey AS hcp_id, l_suppkey AS rep_id, week_end_date, {_METRICS} FROM lines GROUP BY 1, 2, 3)"
RAW = f"""{DENSE}, raw AS (
  SELECT CASE WHEN trx % 17 = 0 THEN NULL ELSE hcp_id END AS hcp_id, rep_id,
    CASE WHEN trx % 29 = 0 THEN 'not a date' ELSE strftime(week_end_date, '%Y-%m-%d') END AS week_end_date,
    CASE WHEN suggestion_email % 5 = 4 THEN 'bad' WHEN suggestion_email % 5 = 3 THEN NULL
         ELSE ' ' || CAST(suggestion_email AS VARCHAR) END AS suggestion_email,
    suggestion_call, action_email, action_call, CASE WHEN trx % 3 = 0 THEN NULL ELSE trx END AS trx, nbrx
  FROM dense)"""
EVENTS = """
events_panel AS (
  SELECT user_id AS hcp_id, user_id % 5 AS rep_id, CAST(ts AS DATE) AS event_date,
    CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS suggestion_view,
    CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS action_click,
    SUM(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END) AS outcome_trx
  FROM events GROUP BY 1, 2, 3)"""
TOTALS = f"""{DENSE}, totals AS (
  SELECT *, CAST(suggestion_email + suggestion_call AS DOUBLE) AS suggestion_total,
    CAST(action_email + action_call AS DOUBLE) AS action_total, strftime(week_end_date, '%Y-%m') AS month_label
  FROM dense)"""
_SUGGESTED = "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
LONG = f"""{_LINES}, panel AS (
  SELECT {_NAMES[1]} AS rep_id, {_NAMES[0]} AS customer_id, week_end_date, {_METRICS},
    ROUND(AVG(s_acctbal), 9) AS confound_path_a_suppbal, ROUND(AVG(c_acctbal), 9) AS confound_path_b_custbal,
    CAST(SUM(CASE WHEN {_SUGGESTED} AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS theme_f_qualified,
    CAST(SUM(CASE WHEN {_SUGGESTED} AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS theme_o_qualified,
    CAST(COUNT(*) AS DOUBLE) AS covariate_path_b_lines
  FROM lines GROUP BY 1, 2, 3),
segment AS (
  SELECT rep_id, customer_id, week_end_date, c_mktsegment AS covariate_path_a_segment FROM (
    SELECT {_NAMES[1]} AS rep_id, {_NAMES[0]} AS customer_id, week_end_date, c_mktsegment,
      ROW_NUMBER() OVER (PARTITION BY n_regionkey, c_nationkey, week_end_date ORDER BY COUNT(*) DESC, c_mktsegment) AS k
    FROM lines GROUP BY n_regionkey, c_nationkey, week_end_date, c_mktsegment) WHERE k = 1),
long AS MATERIALIZED (
  SELECT p.rep_id, p.customer_id, p.week_end_date, t.kind AS suggestion_type, t.kind AS action_type, o.outcome_type,
    CAST(CASE WHEN t.kind = 'email' THEN suggestion_email ELSE suggestion_call END AS DOUBLE) AS suggestion_count,
    CAST(CASE WHEN t.kind = 'email' THEN action_email ELSE action_call END AS DOUBLE) AS action_count,
    CAST(CASE WHEN o.outcome_type = 'trx' THEN trx ELSE nbrx END AS DOUBLE) AS outcome_count,
    confound_path_a_suppbal, confound_path_b_custbal, s.covariate_path_a_segment, covariate_path_b_lines,
    theme_f_qualified, theme_o_qualified
  FROM panel p JOIN segment s USING (rep_id, customer_id, week_end_date)
    CROSS JOIN (VALUES ('email'), ('call')) t(kind) CROSS JOIN (VALUES ('trx'), ('nbrx')) o(outcome_type))"""
# The long panel's keys and counts alone: the lines are read and grouped once.
LONG_COUNTS = f"""{_LINES}, panel AS (SELECT {_NAMES[1]} AS rep_id, {_NAMES[0]} AS customer_id, week_end_date, {_METRICS} FROM lines GROUP BY 1, 2, 3),
long AS MATERIALIZED (
  SELECT rep_id, customer_id, week_end_date, t.kind AS suggestion_type, t.kind AS action_type, o.outcome_type,
    CAST(CASE WHEN t.kind = 'email' THEN suggestion_email ELSE suggestion_call END AS DOUBLE) AS suggestion_count,
    CAST(CASE WHEN t.kind = 'email' THEN action_email ELSE action_call END AS DOUBLE) AS action_count
  FROM panel CROSS JOIN (VALUES ('email'), ('call')) t(kind) CROSS JOIN (VALUES ('trx'), ('nbrx')) o(outcome_type))"""
# The factual scores of path A alone, for queries that need no more of PREDICTIONS.
ACTION_SCORES = f"""{LONG_COUNTS}, af AS (
  SELECT *, CASE WHEN action_count < 9 THEN action_count * 0.75 + suggestion_count * 0.5 - 1.0 END AS prediction,
    suggestion_count * 0.25 AS propensity_a
  FROM long WHERE suggestion_type = 'call' AND action_type = 'call' AND outcome_type = 'trx')"""
PREDICTIONS = f"""{LONG}, path_a AS (
  SELECT * FROM long WHERE suggestion_type = 'call' AND action_type = 'call' AND outcome_type = 'trx'),
af AS (SELECT *, CASE WHEN action_count < 9 THEN action_count * 0.75 + suggestion_count * 0.5 - 1.0 END AS prediction,
    suggestion_count * 0.25 AS propensity_a FROM path_a),
ac AS (SELECT *, action_count * 0.75 - 1.0 AS prediction FROM path_a),
path_b AS (
  SELECT customer_id, week_end_date, outcome_type, SUM(action_count) AS action_count, SUM(suggestion_count) AS suggestion_count,
    SUM(outcome_count) AS outcome_count
  FROM long WHERE suggestion_type = 'call' AND action_type = 'call' GROUP BY 1, 2, 3),
bf AS (SELECT *, outcome_count * 0.5 + action_count * 0.25 - 20.0 AS prediction, action_count * 0.125 AS propensity_b FROM path_b),
bc AS (SELECT *, outcome_count * 0.5 - 20.0 AS prediction FROM path_b)"""
