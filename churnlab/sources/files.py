"""File, SQL and JDBC sources/sinks.

Schemas are always explicit (never ``inferSchema``), so a scan of 100 TB does
not need a sampling pass and bad records are routed, not guessed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("age", T.DoubleType(), True),
    T.StructField("tenure_months", T.DoubleType(), True),
    T.StructField("contract_type", T.StringType(), True),
    T.StructField("plan_tier", T.StringType(), True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("monthly_charges", T.DoubleType(), True),
    T.StructField("total_charges", T.DoubleType(), True),
    T.StructField("num_support_tickets_30d", T.DoubleType(), True),
    T.StructField("login_frequency_30d", T.DoubleType(), True),
    T.StructField("feature_adoption_rate", T.DoubleType(), True),
    T.StructField("nps_score", T.DoubleType(), True),
    T.StructField("usage_30d", T.DoubleType(), True),
    T.StructField("usage_60d", T.DoubleType(), True),
    T.StructField("usage_90d", T.DoubleType(), True),
    T.StructField("days_since_last_login", T.DoubleType(), True),
    T.StructField("churn", T.IntegerType(), True),
])

# Union of the four audit record kinds (decision, feedback, crm action, retrain trigger).
AUDIT_SCHEMA = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("risk_tier", T.StringType()),
    T.StructField("churn_prob", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("decided_by", T.StringType()),
    T.StructField("slack_sent", T.BooleanType()),
    T.StructField("notes", T.StringType()),
    T.StructField("feedback_id", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("submitted_by", T.StringType()),
    T.StructField("action_id", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("ab_group", T.StringType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("feedback_count", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])


def read_customers(spark: SparkSession, path: str, schema: T.StructType = CUSTOMER_SCHEMA,
                   corrupt_col: str = "_corrupt_record") -> DataFrame:
    """CSV with a header and a declared schema; malformed lines are kept in ``corrupt_col``.

    NaN in numeric columns becomes SQL NULL (``nanvl``), since Spark orders NaN
    above every number and ``avg`` would propagate it.
    """
    s = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType(), True)])
    df = (spark.read.schema(s).option("header", "true").option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", corrupt_col).csv(path))
    fixes = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double"))
             for f in schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(fixes)


def read_audit(spark: SparkSession, path: str, n: int | None = None, schema: T.StructType = AUDIT_SCHEMA) -> DataFrame:
    """JSON-lines audit log; malformed lines are dropped.  ``n`` keeps the newest n (a top-k, not a scan cap)."""
    df = (spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
          .withColumn("ts", F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))
    if n is not None:
        df = df.orderBy(F.col("ts").desc_nulls_last(), F.col("event"), F.col("run_id")).limit(n)
    return df


def append_audit(df: DataFrame, path: str, ts_col: str | None = "timestamp") -> None:
    """Append records as JSON lines; the timestamp is ISO with 1-second precision, UTC."""
    if ts_col and ts_col in df.columns:
        df = df.withColumn(ts_col, F.date_format(F.col(ts_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    df.write.mode("append").json(path)


_READ_ONLY = re.compile(r"^\s*(\(\s*)*(select|with)\b", re.IGNORECASE)


def sql_select(spark: SparkSession, q: str, args: dict | None = None) -> DataFrame:
    """Parameterised read-only query: named markers ``:name`` bound via ``args``.

    Only SELECT / WITH statements are accepted (first keyword); values are
    bound, never formatted into the text.
    """
    if not _READ_ONLY.match(q) or ";" in q.strip().rstrip(";"):
        raise ValueError("only a single SELECT / WITH statement is allowed")
    return spark.sql(q, args=args or {})


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
               properties: dict | None = None) -> DataFrame:
    """JDBC table read, split into ``num_partitions`` range reads on ``partition_column``."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower))
             .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return r.load()


def coalesce_sources(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``a``, plus rows of ``b`` whose key ``a`` lacks.  A key never gets another key's row."""
    keys = [key] if isinstance(key, str) else list(key)
    return a.unionByName(b.join(a.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
