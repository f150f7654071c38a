"""Structured Streaming forms of the event operators.

* Sources: ``readStream`` on a parquet folder with a declared schema (the
  event time is cast to TIMESTAMP, as watermarks reject TIMESTAMP_NTZ).
* Sinks: append-only parquet folders under the shared checkpoint directory.
  Keyed results use a merge-on-read layout: every micro-batch writes its
  upserts to ``<path>/_batch=<id>`` (idempotent on replay) and readers keep the
  newest row per key, so no micro-batch rewrites the whole table.
* State: built-in streaming aggregation with watermarks where it suffices; elsewhere a
  table of open rows that each micro-batch reads and hands on (no per-key Python state).
"""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlab.functions.features import risk_tier
from churnlab.operators.events import changes, decision_timeout, lives, merge_runs, run_pieces, unexpired, write_pieces
from churnlab.operators.prefix import prefix_sum
from churnlab.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["events_stream", "scratch_path", "run_available_now", "windowed_counts_stream", "progress_latest_stream",
           "decision_timeout_stream", "feedback_retrain_stream", "dedupe_stream", "upsert_customers_stream",
           "read_upserts", "change_feed_stream", "run_complete_stream"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint directory (never a machine-local temp folder)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:  # a folder of files, so many per micro-batch
        return r.option("maxFilesPerTrigger", str(max_files)).parquet(f"{sf_dir.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return r.option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available_now(writer, timeout_s: int = 600) -> int:
    """Runs a query over what there is; returns the rows that its watermarks dropped.

    The query keeps its last 100 progress records only, so they are read all along, by micro-batch."""
    q = writer.trigger(availableNow=True).start()
    dropped: dict[int, int] = {}
    until = time.monotonic() + timeout_s
    while True:
        ended = q.awaitTermination(0.5)
        for p in q.recentProgress:
            dropped[p.batchId] = max(dropped.get(p.batchId, 0), sum(int(op.get("numRowsDroppedByWatermark", 0)) for op in (p.stateOperators or [])))
        if ended or time.monotonic() > until:
            break
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return sum(dropped.values())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there (other errors are raised, not taken for absence)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _batch_writer(path: str):
    def write(df: DataFrame, batch_id: int):
        df.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")
    return write


def read_upserts(spark: SparkSession, path: str, keys, schema: T.StructType | None = None) -> DataFrame:
    """Merge-on-read: newest micro-batch row per key."""
    if schema is not None and not path_exists(spark, path):  # no batch written yet
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "_batch")


# ---------------------------------------------------------------------------------------------
def windowed_counts_stream(spark: SparkSession, sf_dir: str, size: str = "1 hour", watermark: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """Per-window event counts; update mode into the upsert sink.  Equals the batch result on all rows within the
    watermark delay; later ones are dropped (:func:`windowed_counts_run` also returns how many
    partial window counts that were)."""
    return windowed_counts_run(spark, sf_dir, size, watermark, max_files)[0]


def windowed_counts_run(spark, sf_dir, size: str = "1 hour", watermark: str = "1 hour", max_files: int | None = None) -> tuple[DataFrame, int]:
    s = events_stream(spark, sf_dir, max_files).withWatermark("ts", watermark)
    agg = s.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    agg = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n")
    path, ck = scratch_path(spark, "win"), scratch_path(spark, "win-ck")
    late = run_available_now(agg.writeStream.outputMode("update").option("checkpointLocation", ck).foreachBatch(_batch_writer(path)))
    return read_upserts(spark, path, ["window_start", "event_type"]), late


# ---- event-time work with its open rows in a table ---------------------------------------------
NO_MARK = -(1 << 62)


def _advance_by_time(spark: SparkSession, s: DataFrame, rows, advance, held: str, final: str, watermark: str, name: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Keyed work whose results are final once the watermark has passed them; what is open lies in a table of rows.

    ``rows(micro-batch)``: its rows with their time ``t`` in microseconds.  ``advance(rows, held, mark) -> (final, held)``:
    no row before ``mark`` is to come.  The mark is the latest time seen less the delay; rows before the mark that earlier
    micro-batches left, and rows without a time, are dropped and counted.  Each micro-batch reads what its predecessor
    held and writes its own tables, so a replayed one writes the same again.  No key is gathered in one row or one
    Python object; how rows are dealt out is up to ``advance``.  Returns (final rows, rows held at the end, mark, dropped)."""
    path = scratch_path(spark, name)
    delay = pd.Timedelta(watermark) // pd.Timedelta(microseconds=1)

    def table(part: str, schema: str, batch: str = "*") -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{part}/{batch}")

    def clock(before: int | None = None):
        c = table("clock", "batch long, seen long, dropped long") if path_exists(spark, f"{path}/clock") else spark.createDataFrame([], "batch long, seen long, dropped long")
        c = c if before is None else c.filter(F.col("batch") < before)
        r = c.agg(F.max("seen").alias("seen"), F.sum("dropped").alias("dropped"), F.max("batch").alias("batch")).first()
        return (r["seen"] // 1000 * 1000 - delay if r["seen"] is not None else NO_MARK), r["dropped"] or 0, r["batch"]

    def per_batch(df: DataFrame, batch_id: int):
        mark, _, last = clock(batch_id)
        df = df.persist()
        in_time = F.coalesce(F.col("t") >= mark, F.lit(False))
        seen = df.agg(F.max(F.unix_micros("ts"))).first()[0]
        mark = max(mark, seen // 1000 * 1000 - delay) if seen is not None else mark
        mine = rows(df)
        was = table("held", held, str(last)) if last is not None else spark.createDataFrame([], held)
        done, on = advance(mine.filter(in_time), was, mark)
        done.write.mode("overwrite").parquet(f"{path}/final/{batch_id}")
        on.write.mode("overwrite").parquet(f"{path}/held/{batch_id}")
        mine.agg(F.lit(batch_id).cast("long").alias("batch"), F.lit(seen).cast("long").alias("seen"), F.count_if(~in_time).alias("dropped")) \
            .write.mode("overwrite").parquet(f"{path}/clock/{batch_id}")
        df.unpersist()

    run_available_now(s.writeStream.option("checkpointLocation", f"{path}/ck").foreachBatch(per_batch))
    if not path_exists(spark, f"{path}/clock"):  # no micro-batch
        return spark.createDataFrame([], final), spark.createDataFrame([], held), NO_MARK, 0
    mark, dropped, last = clock()
    return table("final", final), table("held", held, str(last)), mark, dropped


PROGRESS_OUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                             T.StructField("value", T.DoubleType()), T.StructField("event_id", T.LongType())])


def progress_latest_stream(spark: SparkSession, sf_dir: str, delay: str = "0 seconds", max_files: int | None = None,
                           keep_seconds: int | None = None) -> DataFrame:
    """Latest record per key by (time, id): every micro-batch writes its latest per key, readers keep the newest that has
    not expired.

    The comparison is by event time, so order of arrival, lateness and the number of micro-batches do not matter."""
    s = events_stream(spark, sf_dir, max_files)
    path, ck = scratch_path(spark, "progress"), scratch_path(spark, "progress-ck")
    newest = F.max_by(F.struct("event_type", "value", "event_id"), F.struct("ts", "event_id"))

    def per_batch(df: DataFrame, batch_id: int):
        df.groupBy("user_id").agg(newest.alias("r"), F.max(F.struct("ts", "event_id")).alias("at")).write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    run_available_now(s.writeStream.option("checkpointLocation", ck).foreachBatch(per_batch))
    if not path_exists(spark, path):
        return spark.createDataFrame([], PROGRESS_OUT)
    latest = spark.read.parquet(path).groupBy("user_id").agg(F.max_by("r", "at").alias("r"), F.max("at.ts").alias("at"))
    return unexpired(latest, "at", keep_seconds).select("user_id", "r.*")


def dedupe_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, keep_seconds: int = 90 * 86_400) -> DataFrame:
    """One row per (user, event type): the last write within its time to live, with the number of writes.  A micro-batch writes
    its pieces of the keys' lives; readers merge the pieces, so arrival order does not matter."""
    path, ck = scratch_path(spark, "dedupe"), scratch_path(spark, "dedupe-ck")
    keys = ["user_id", "event_type"]

    def per_batch(df: DataFrame, batch_id: int):
        write_pieces(df, keys, "ts", "event_id", ["value"], keep_seconds).write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    run_available_now(events_stream(spark, sf_dir, max_files).writeStream.option("checkpointLocation", ck).foreachBatch(per_batch))
    if not path_exists(spark, path):
        return spark.createDataFrame([], "user_id long, event_type string, event_id long, value double, since timestamp, n_writes long")
    got = lives(spark.read.parquet(path).drop("_batch"), keys, keep_seconds)
    return got.select(*keys, "last.event_id", "last.value", "since", F.col("n").alias("n_writes"))


# ---- decision timeout: requests stay open until the watermark is past their limit -------------
DECISION_ROWS = "user_id long, event_id long, t long, kind int, tier string, decision string"
DECISION_OUT = "request_id long, user_id long, risk_tier string, status string, decision_id long, wait_seconds double"


def decision_timeout_stream(spark: SparkSession, sf_dir: str, seconds: int = 1800, watermark: str = "0 seconds",
                            max_files: int | None = None) -> DataFrame:
    """Outcome of every request, those still open included (they stand as auto-approved, as in the batch form)."""
    return decision_timeout_run(spark, sf_dir, seconds, watermark, max_files)[0]


def decision_timeout_run(spark, sf_dir, seconds: int = 1800, watermark: str = "0 seconds", max_files: int | None = None) -> tuple[DataFrame, int]:
    """(outcomes, rows dropped as late).  A micro-batch settles the requests whose limit the watermark has passed with the batch
    operator, which deals rows out by user and time bucket; the other requests, and decisions that may answer them, are held."""
    limit = seconds * 1_000_000

    def rows(df):
        return df.filter(F.col("event_type").isin("view", "click", "error")).select(
            "user_id", "event_id", F.unix_micros("ts").alias("t"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("kind"),
            risk_tier(F.least(F.col("value") / 100.0, F.lit(1.0))).alias("tier"),
            F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "error", "rejected").alias("decision"))

    def settle(asked, answers):
        at = F.timestamp_micros("t")
        req = asked.select(F.col("event_id").alias("request_id"), "user_id", at.alias("request_ts"), F.col("tier").alias("risk_tier"))
        dec = answers.filter(F.col("kind") == 1).select("user_id", at.alias("decision_ts"), F.col("event_id").alias("decision_id"), "decision")
        return decision_timeout(req, dec, seconds)

    def advance(new, held, mark):
        u, past = new.unionByName(held), F.col("t") < mark - limit
        return settle(u.filter((F.col("kind") == 0) & past), u), u.filter(~past)

    done, held, _, dropped = _advance_by_time(spark, events_stream(spark, sf_dir, max_files), rows, advance, DECISION_ROWS, DECISION_OUT, watermark, "decisions")
    return done.unionByName(settle(held.filter(F.col("kind") == 0), held)), dropped


# ---- run completion: terminal status or a 5-minute inactivity limit ---------------------------
RUN_ROWS = "user_id long, steps long, first_t long, t long, event_id long, event_type string"
RUN_OUT = "user_id long, steps long, last_event_id long, status string"


def run_complete_stream(spark: SparkSession, sf_dir: str, limit_seconds: int = 300, terminal: str = "purchase", watermark: str = "0 seconds",
                        max_files: int | None = None) -> DataFrame:
    """One record per run (a user's events up to a terminal event): complete, timed out, or pending at the end."""
    return run_complete_run(spark, sf_dir, limit_seconds, terminal, watermark, max_files)[0]


def run_complete_run(spark, sf_dir, limit_seconds: int = 300, terminal: str = "purchase", watermark: str = "0 seconds",
                     max_files: int | None = None) -> tuple[DataFrame, int]:
    """(runs, rows dropped as late).  Held are the rows that the watermark has not passed and one row per run that may go on."""
    limit = limit_seconds * 1_000_000
    ended = F.coalesce(F.col("event_type") == terminal, F.lit(False))

    def record(r, status):
        return r.select("user_id", "steps", F.col("event_id").alias("last_event_id"), status.alias("status"))

    def advance(new, held, mark):
        u = new.unionByName(held)
        ready = cut_lineage(merge_runs(u.filter(F.col("t") < mark), limit_seconds, terminal))
        open_ = ~ended & (F.col("t") + limit >= mark)  # a run that another ready row follows is older than that
        waiting = u.filter(F.col("t") >= mark).unionByName(ready.filter(open_).drop("is_last"))
        return record(ready.filter(~open_), F.when(ended, "complete").otherwise("timeout")), waiting

    s = events_stream(spark, sf_dir, max_files)
    done, held, _, dropped = _advance_by_time(spark, s, run_pieces, advance, RUN_ROWS, RUN_OUT, watermark, "runs")
    status = F.when(ended, "complete").when(F.col("is_last"), "pending").otherwise("timeout")
    return done.unionByName(record(merge_runs(held, limit_seconds, terminal), status)), dropped


# ---- feedback counter: running count across micro-batches, trigger every n ----------------------
def feedback_retrain_stream(spark: SparkSession, sf_dir: str, every: int = 50, max_files: int | None = None) -> DataFrame:
    """A trigger at every multiple of ``every``, counted in order of arrival: micro-batch, then event time, then id.

    With in-order files this is the batch order.  A replayed micro-batch writes the same rows again."""
    base = scratch_path(spark, "feedback")
    counts, triggers = f"{base}/counts", f"{base}/triggers"

    def per_batch(df: DataFrame, batch_id: int):
        s = df.sparkSession
        prev = s.read.parquet(f"{counts}/{batch_id - 1}").first()["n"] if batch_id else 0  # the running total so far, one row
        f = df.filter(F.col("event_type") == "purchase").select("event_id", "ts", F.unix_micros("ts").alias("_t"), F.lit(1).alias("_one"))
        c = prefix_sum(f, "_t", ["_one"], tiebreak=[F.col("event_id").asc()])
        c.agg((F.count(F.lit(1)) + F.lit(prev)).alias("n")).write.mode("overwrite").parquet(f"{counts}/{batch_id}")
        t = c.select("event_id", "ts", (F.col("cum__one") + F.lit(prev)).alias("feedback_count")).filter(F.col("feedback_count") % every == 0)
        t.write.mode("overwrite").parquet(f"{triggers}/_batch={batch_id}")

    run_available_now(events_stream(spark, sf_dir, max_files).writeStream.option("checkpointLocation", f"{base}/ck").foreachBatch(per_batch))
    return spark.read.parquet(triggers).drop("_batch")


# ---- customer edits: upsert (latest non-null per column) and change feed -----------------------
EDITABLE = ["contract_type", "monthly_charges", "num_support_tickets_30d", "feature_adoption_rate", "nps_score"]


def edits_from_events(s: DataFrame) -> DataFrame:
    v, t = F.col("value"), F.col("event_type")
    return s.select(F.col("user_id").alias("customer_id"), F.col("ts").alias("updated_at"),
                    F.when(t == "click", F.when(v > 50, "Two Year").otherwise("One Year")).alias("contract_type"),
                    F.when(t == "purchase", v).alias("monthly_charges"), F.when(t == "error", v).alias("num_support_tickets_30d"),
                    F.when(t == "view", v / 100.0).alias("feature_adoption_rate"), F.when(t == "signup", v).alias("nps_score"))


def upsert_customers_stream(spark: SparkSession, sf_dir: str, base: DataFrame, max_files: int | None = None) -> DataFrame:
    """Apply streamed edits to the base table: per batch latest non-null value per column, merged on read."""
    path, ck = scratch_path(spark, "edits"), scratch_path(spark, "edits-ck")

    def per_batch(df: DataFrame, batch_id: int):
        g = df.groupBy("customer_id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(c) for c in EDITABLE],
                                          *[F.max(F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(f"_ts_{c}") for c in EDITABLE])
        g.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    run_available_now(edits_from_events(events_stream(spark, sf_dir, max_files)).writeStream.option("checkpointLocation", ck).foreachBatch(per_batch))
    e = spark.read.parquet(path)
    latest = e.groupBy("customer_id").agg(*[F.max_by(F.col(c), F.col(f"_ts_{c}")).alias(f"_e_{c}") for c in EDITABLE])
    j = base.join(latest, "customer_id", "left")
    return j.select(*[F.coalesce(F.col(f"_e_{c}"), F.col(c)).alias(c) if c in EDITABLE else F.col(c) for c in base.columns])


def long_edits(s: DataFrame) -> DataFrame:
    """customer_id, field, num, text, at, tie: one row per edited field."""
    kind = {"click": "contract_type", "purchase": "monthly_charges", "error": "num_support_tickets_30d", "view": "feature_adoption_rate", "signup": "nps_score"}
    v, t = F.col("value"), F.col("event_type")
    field = F.coalesce(*[F.when(t == k, F.lit(c)) for k, c in kind.items()])
    num = F.when(t == "view", v / 100.0).when(t != "click", v)
    text = F.when(t == "click", F.when(v > 50, "Two Year").otherwise("One Year"))
    rows = s.select(F.col("user_id").alias("customer_id"), field.alias("field"), num.alias("num"), text.alias("text"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))
    return rows.filter(F.col("field").isNotNull() & (F.col("num").isNotNull() | F.col("text").isNotNull()))  # nulls keep the value


def long_values(base: DataFrame) -> DataFrame:
    """customer_id, field, num, text of the editable columns."""
    none = F.lit(None)
    pairs = [F.struct(F.lit(c).alias("field"), (none if c == "contract_type" else F.col(c)).cast("double").alias("num"),
                      (F.col(c) if c == "contract_type" else none).cast("string").alias("text")) for c in EDITABLE]
    return base.select("customer_id", F.explode(F.array(*pairs)).alias("p")).select("customer_id", "p.*")


def change_feed_stream(spark: SparkSession, sf_dir: str, base: DataFrame, max_files: int | None = None) -> DataFrame:
    """Change capture against each customer's current values, which the changes move on.

    A micro-batch reads the values that its predecessor left (one table per micro-batch, so a replayed one writes the same
    again), and writes its changes and the values after them.  Within a micro-batch the order is event time."""
    path = scratch_path(spark, "changes")
    long_values(base).write.parquet(f"{path}/values/-1")

    def per_batch(df: DataFrame, batch_id: int):
        known = df.sparkSession.read.parquet(f"{path}/values/{batch_id - 1}")
        ed = long_edits(df).persist()
        changes(ed, known).write.mode("overwrite").parquet(f"{path}/feed/_batch={batch_id}")
        last = ed.groupBy("customer_id", "field").agg(F.max_by(F.struct("num", "text"), F.struct("at", "tie")).alias("_l"))
        j = known.join(last, ["customer_id", "field"], "left")
        after = F.coalesce("_l", F.struct("num", "text"))
        j.select("customer_id", "field", after["num"].alias("num"), after["text"].alias("text")).write.mode("overwrite").parquet(f"{path}/values/{batch_id}")
        ed.unpersist()

    run_available_now(events_stream(spark, sf_dir, max_files).writeStream.option("checkpointLocation", f"{path}/ck").foreachBatch(per_batch))
    if not path_exists(spark, f"{path}/feed"):
        return spark.createDataFrame([], "customer_id long, at timestamp, field string, old_num double, new_num double, old_text string, new_text string")
    return spark.read.parquet(f"{path}/feed").drop("_batch")
