"""The sample tables seen as evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import reshape
from ..session import spread

BASELINE = "5-LOW"
CRITERIA = ["c_readability", "c_architecture", "c_adherence", "c_correctness"]
DIMS = scoring.DIMENSIONS

RUNS_SQL = """
SELECT o.o_orderstatus AS model,
       o.o_orderpriority AS profile,
       concat(lower(p.p_type), '-0', CAST(p.p_size % 3 + 1 AS STRING)) AS task,
       CAST(year(o.o_orderdate) AS INT) AS run_set,
       l.l_orderkey AS k1, l.l_linenumber AS k2, l.l_partkey AS k3, l.l_suppkey AS k4,
       CAST(l.l_quantity AS INT) AS tests_passed, 50 AS tests_total,
       CAST(round(l.l_discount * 100) AS INT) AS lint_errors,
       p.p_size AS loc, CAST(p.p_size AS DOUBLE) AS avg_complexity,
       CAST(l.l_linenumber % 5 + 1 AS INT) AS c_readability,
       CAST(l.l_suppkey % 5 + 1 AS INT) AS c_architecture,
       CAST(l.l_partkey % 5 + 1 AS INT) AS c_adherence,
       CAST(l.l_orderkey % 5 + 1 AS INT) AS c_correctness,
       CAST(floor(l.l_extendedprice / 10) AS BIGINT) AS input_tokens,
       CAST(l.l_quantity * 40 AS BIGINT) AS output_tokens,
       l.l_tax * 1000 AS duration_seconds,
       l.l_returnflag <> 'R' AS success,
       CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 'Rate limit: too many requests'
            WHEN l.l_returnflag = 'R' THEN 'SSO session has expired' END AS error
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey
"""

# Prices per million tokens (in, out) of the models that have their own; others pay the default.
PRICES = [("F", 1.0, 5.0), ("O", 3.0, 15.0)]
DEFAULT_PRICE = (3.0, 15.0)


class Tables:
    """Lazy access to one folder of parquet tables and to the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def runs(self) -> DataFrame:
        return self._runs(self.lineitem)

    @property
    def spread_runs(self) -> DataFrame:
        """Runs joined in more parts, for what needs them by k1."""
        return self._runs(spread(self.lineitem, "l_orderkey"))

    def _runs(self, lineitem: DataFrame) -> DataFrame:
        return self.spark.sql(RUNS_SQL, lineitem=lineitem, orders=self.orders, part=self.part)

    @property
    def scored(self) -> DataFrame:
        """Runs with their scores as columns; failed runs have none."""
        runs = self.runs.withColumns({
            "test_pass_rate": scoring.test_pass_rate("tests_passed", "tests_total"),
            "lint_score": scoring.lint_score("lint_errors", "loc"),
            "complexity_score": scoring.complexity_score("avg_complexity"),
            "judge_avg": scoring.judge_average(CRITERIA),
            "token_count": F.col("input_tokens") + F.col("output_tokens"),
        })
        df = scoring.static_total(runs)
        df = df.withColumn("llm_quality", scoring.judge_normalized("judge_avg"))
        df = df.withColumn("composite", scoring.composite("static_total", "llm_quality"))
        names = [*DIMS, "static_total"]
        return df.withColumns({c: F.when(F.col("success"), F.col(c)) for c in names})

    @property
    def quality(self) -> DataFrame:
        """Scored runs with one quality number each, the mean of all dimensions."""
        return self.scored.withColumn("quality", scoring.run_quality_wide(DIMS))

    @property
    def run_scores(self) -> DataFrame:
        return reshape.to_long(self.scored, DIMS)

    @property
    def pricing(self) -> DataFrame:
        return self.spark.sql(f"WITH {PRICES_CTE} SELECT * FROM pricing")

    @property
    def judgements(self) -> DataFrame:
        """Four criterion scores per run; the tier comes from the return flag."""
        flags = self.lineitem.alias("l")
        return judgements_from(self.spark, flags, self.orders, self.part)

    @property
    def run_events(self) -> DataFrame:
        return run_events_from(self.events)


JUDGED_SQL = """
SELECT o.o_orderstatus AS model,
       concat(lower(p.p_type), '-0', CAST(p.p_size % 3 + 1 AS STRING)) AS task,
       CASE l.l_returnflag WHEN 'A' THEN 'gold' WHEN 'N' THEN 'mild' ELSE 'severe' END AS tier,
       l.l_linenumber AS rep,
       CAST(l.l_linenumber % 5 + 1 AS INT) AS readability,
       CAST(l.l_suppkey % 5 + 1 AS INT) AS architecture,
       CAST(l.l_partkey % 5 + 1 AS INT) AS adherence,
       CAST(l.l_orderkey % 5 + 1 AS INT) AS correctness
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey
"""


def judgements_from(spark, lineitem, orders, part) -> DataFrame:
    """One row per judged sample with its criteria as columns and the normalized score."""
    df = spark.sql(JUDGED_SQL, lineitem=lineitem, orders=orders, part=part)
    avg = scoring.judge_average(["readability", "architecture", "adherence", "correctness"])
    return df.withColumn("normalized", scoring.judge_normalized(avg))


def run_events_from(events: DataFrame) -> DataFrame:
    """Stream or table of events as the life of runs, a worker per user."""
    return events.select(
        "event_id", "ts",
        F.col("user_id").alias("worker_id"),
        (F.col("user_id") % 5).cast("string").alias("model"),
        F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "done")
        .when(F.col("event_type") == "click", "start").otherwise("progress").alias("status"),
        (F.col("value") / 1000.0).alias("cost"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "value",
    )


# --- the same frames for the SQL side --------------------------------------------------------

_R2 = "(floor(CAST({} AS DOUBLE) * 1e2 + 0.500001) / 1e2)"
_STATIC = "0.5 * tp + 0.3 * li + 0.2 * co"

RUNS_CTE = "runs AS (" + RUNS_SQL.format(lineitem="lineitem", orders="orders", part="part") + ")"

SCORED_CTE = RUNS_CTE + f""",
raw_scores AS (
  SELECT *, input_tokens + output_tokens AS token_count,
         CAST(tests_passed AS DOUBLE) / tests_total * 100 AS tp,
         CASE WHEN loc > 0 THEN greatest(0.0, least(100.0, 100.0 - CAST(lint_errors AS DOUBLE) / loc * 1000)) ELSE 100.0 END AS li,
         CASE WHEN avg_complexity <= 1 THEN 100.0
              WHEN avg_complexity <= 5 THEN 100 - 5 * (avg_complexity - 1)
              WHEN avg_complexity <= 10 THEN 80 - 4 * (avg_complexity - 5)
              WHEN avg_complexity <= 20 THEN 60 - 2 * (avg_complexity - 10)
              WHEN avg_complexity <= 30 THEN 40 - 2 * (avg_complexity - 20)
              WHEN avg_complexity <= 40 THEN 20 - 1.5 * (avg_complexity - 30)
              ELSE greatest(0.0, 5 - 0.5 * (avg_complexity - 40)) END AS co,
         CAST(c_readability + c_architecture + c_adherence + c_correctness AS DOUBLE) / 4 AS judge_avg
  FROM runs),
parts AS (
  SELECT *, {_R2.format('tp')} AS r_tp, {_R2.format('li')} AS r_li, {_R2.format('co')} AS r_co,
         {_R2.format(_STATIC)} AS r_st, {_R2.format('(judge_avg - 1) * 25')} AS r_lq
  FROM raw_scores),
scored AS (
  SELECT * EXCLUDE (tp, li, co, r_tp, r_li, r_co, r_st, r_lq),
         CASE WHEN success THEN r_tp END AS test_pass_rate,
         CASE WHEN success THEN r_li END AS lint_score,
         CASE WHEN success THEN r_co END AS complexity_score,
         CASE WHEN success THEN r_lq END AS llm_quality,
         CASE WHEN success THEN r_st END AS static_total,
         CASE WHEN success THEN {_R2.format('0.5 * r_st + 0.5 * r_lq')} END AS composite
  FROM parts)"""

QUALITY_CTE = SCORED_CTE + """,
quality AS (
  SELECT *, (composite + test_pass_rate + lint_score + complexity_score + llm_quality) / 5 AS quality
  FROM scored)"""

LONG_CTE = SCORED_CTE + "".join([""",
run_scores AS (""", " UNION ALL ".join(
    f"SELECT model, profile, task, run_set, k1, k2, k3, k4, success, token_count, '{d}' AS dimension, {d} AS score "
    f"FROM scored WHERE {d} IS NOT NULL" for d in DIMS), ")"])

JUDGED_CTE = "judged AS (" + JUDGED_SQL.format(lineitem="lineitem", orders="orders", part="part") + f"""),
judgements AS (SELECT *, {_R2.format('((readability + architecture + adherence + correctness) / 4.0 - 1) * 25')} AS normalized
  FROM judged)"""

EVENTS_CTE = """run_events AS (
  SELECT event_id, ts, user_id AS worker_id, CAST(user_id % 5 AS VARCHAR) AS model,
         CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'start' ELSE 'progress' END AS status,
         value / 1000.0 AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value
  FROM events)"""

PRICES_CTE = "pricing(model, price_in, price_out) AS (VALUES " + ", ".join(
    f"('{m}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in PRICES) + ")"
