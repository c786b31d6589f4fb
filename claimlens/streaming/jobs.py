"""Structured Streaming jobs (ST1-ST3).

ST1 scores arriving claims: a stream-static left join attaches patient history
(a static snapshot re-read per micro-batch inside ``foreachBatch``), the rule /
model score, tier and factors are projected, and each micro-batch is written
to its own ``batch=<id>`` folder, so a replayed batch overwrites itself
(idempotent sink).

ST2 keeps the daily summary incrementally: event time is the submission time
(cast to TIMESTAMP, as watermarks require), a watermark bounds lateness and
tumbling one-day windows are emitted in append mode once closed.

ST3 keeps the dashboard counters per risk level as streaming state and writes
the complete table each micro-batch to a folder of its own; readers take the
last finished one, so a table is never seen half-written.

``stream_score_by_model`` is ST1 with fitted state: each micro-batch reads the
last published version of the claim statistics and the model, projects the
features and scores by the model, and by the rules where the model cannot judge.

All checkpoints live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.operators import metrics as mt
from claimlens.operators import ml
from claimlens.operators.stats import ClaimStats
from claimlens.plans import pipeline as pl
from claimlens.session import ensure_checkpoint_dir
from claimlens.sources import operational as op
from claimlens.sources.materialize import materialize


#: Tasks that write one arrival of a feed.
WRITERS = 8


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def _arrival(df: DataFrame, parts: int, order_col: str | None):
    """The number of the arriving batch of a row: time ranges when ordered, else dealt by hash."""
    if not order_col:
        return F.pmod(F.xxhash64(*[F.col(c) for c in df.columns[:1]]), F.lit(parts)).cast("int")
    t = F.col(order_col).cast("timestamp").cast("double")
    bounds = df.select(t.alias("__t")).agg(
        F.percentile_approx("__t", [i / parts for i in range(1, parts)], 10000)).first()[0] or []
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(b) for b in sorted(set(float(b) for b in bounds))])
    return F.when(t.isNull(), 0).otherwise(F.size(F.filter(edges, lambda edge: edge < t)))


def feed_and_run(df: DataFrame, path: str, parts: int, order_col: str | None, run_once) -> T.StructType:
    """Deliver ``df`` to ``path`` as ``parts`` arriving batches, running the stream after each.

    The rows are written once, partitioned by their arrival number; each arrival reads its own
    partition only. Then the streaming query runs with ``availableNow`` on the same checkpoint, so
    batches are processed strictly in arrival order (time order when ``order_col`` is given, rows
    without a time first) -- as a live feed would deliver them -- independent of file
    modification-time resolution."""
    spark = df.sparkSession
    staged = f"{path}-arrivals"
    spread = F.pmod(F.xxhash64(F.col(df.columns[0])), F.lit(WRITERS))
    (df.withColumn("__arrival", _arrival(df, parts, order_col)).repartition(F.col("__arrival"), spread)
       .write.partitionBy("__arrival").parquet(staged))
    fields = [*df.schema.fields, T.StructField("__arrival", T.IntegerType())]
    arrivals = spark.read.schema(T.StructType(fields)).parquet(staged)
    for number in range(parts):
        arrivals.where(F.col("__arrival") == number).drop("__arrival").write.mode("append").parquet(path)
        run_once()
    return df.schema


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream. Without a per-trigger cap, everything that has arrived forms one
    micro-batch, so the files of one arrival are never split into out-of-order batches."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


# ST1
def stream_score_claims(spark: SparkSession, source: str, schema: T.StructType, history: str, sink: str,
                        checkpoint: str) -> None:
    claims = read_stream(spark, source, schema)

    def score(batch: DataFrame, batch_id: int) -> None:
        # Static side re-read per micro-batch, so refreshed history is picked up.
        hist = batch.sparkSession.read.parquet(history)
        enriched = (batch.join(hist, "patient_id", "left")
                         .withColumn("patient_total_claims", F.coalesce("patient_total_claims", F.lit(1)))
                         .withColumn("patient_provider_count", F.coalesce("patient_provider_count", F.lit(1))))
        op.score_claims(enriched).write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))

    q = (claims.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()


# ST1 with fitted state
@dataclass
class ScoringState:
    """What scoring needs of the past: claim statistics, a model and its features, as one published version."""
    version: int
    stats: ClaimStats
    model: PipelineModel
    features: list[str]


def _state_versions(spark: SparkSession, root: str) -> list[int]:
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "version=*", "ready", "_SUCCESS"))
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(s.getPath().getParent().getParent().getName().split("=")[1]) for s in found or [])


def publish_state(spark: SparkSession, root: str, stats: ClaimStats, model: PipelineModel, features: list[str]) -> int:
    """Store a new version; it counts once its last part, the ``ready`` mark, is written."""
    version = (_state_versions(spark, root) or [0])[-1] + 1
    folder = os.path.join(root, f"version={version}")
    stats.save(os.path.join(folder, "stats"))
    ml.ModelStore((os.path.join(folder, "model"),)).save(model, features)
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, "ready"))
    return version


def load_state(spark: SparkSession, root: str) -> ScoringState:
    """The last whole version."""
    versions = _state_versions(spark, root)
    if not versions:
        raise ValueError(f"no scoring state has been published under {root}")
    folder = os.path.join(root, f"version={versions[-1]}")
    model, features = ml.ModelStore((os.path.join(folder, "model"),)).load()
    return ScoringState(versions[-1], ClaimStats.load(spark, os.path.join(folder, "stats")), model, features)


def score_by_model(claims: DataFrame, state: ScoringState) -> DataFrame:
    """Predictions for merged claim rows (J4): statistics joined, features projected, scored by the stored model.

    A claim of a provider that the statistics do not know has no model probability and takes the rule's."""
    kept = ("ClaimID", "__submitted", "HospitalStayDays", "PatientClaimCount", "ProviderClaimCount")
    cleaned = pl.clean_claims(claims.withColumn("__submitted", F.col("ClaimStartDt").cast("timestamp_ntz")))
    ft = pl.finalize_features(pl.with_claim_features(cleaned, state.stats), keep=kept)
    ft = ft.select(*kept, *[F.col(c).cast("double").alias(c) for c in state.features if c not in kept])
    scored = ml.score_batch(state.model, ft)

    def flag(c: str):
        return F.col(f"ChronicCond_{c}") == 1

    rows = scored.select(
        F.col("ClaimID").alias("claim_id"), F.col("InscClaimAmtReimbursed").cast("decimal(12,2)").alias("claim_amount"),
        F.coalesce(F.col("HospitalStayDays").cast("int"), F.lit(0)).alias("hospital_stay_days"),
        F.greatest(F.col("PatientClaimCount").cast("int"), F.lit(1)).alias("patient_total_claims"), F.col("Age").cast("int").alias("patient_age"),
        flag("Diabetes").alias("chronic_diabetes"), flag("Heartfailure").alias("chronic_heartfailure"), flag("Cancer").alias("chronic_cancer"),
        flag("KidneyDisease").alias("chronic_kidney"), F.col("__submitted").alias("submission_date"),
        F.when(F.coalesce(F.col("ProviderClaimCount"), F.lit(0)) > 0, F.col("fraud_probability")).alias("model_probability"))
    return op.score_claims(rows, F.col("model_probability")).withColumn("model_version", F.lit(f"state-{state.version}"))


def stream_score_by_model(spark: SparkSession, source: str, schema: T.StructType, state_root: str, sink: str, checkpoint: str) -> None:
    """Score arriving claims with the state that is the last one when their micro-batch begins."""
    def score(batch: DataFrame, batch_id: int) -> None:
        state = load_state(batch.sparkSession, state_root)
        score_by_model(batch, state).write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))

    q = (read_stream(spark, source, schema).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ST2
def stream_daily_summary(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                         delay: str = "1 day") -> None:
    events = read_stream(spark, source, schema).withColumn("event_time", F.col("submission_date").cast("timestamp"))
    lvl = F.col("risk_level")

    def count_if(c):
        return F.count(F.when(c, F.lit(1)))
    agg = (events.withWatermark("event_time", delay)
                 .groupBy(F.window("event_time", "1 day").alias("w"))
                 .agg(F.count(F.lit(1)).alias("total_claims"),
                      count_if(lvl == "Critical Risk").alias("critical_risk_claims"),
                      count_if(lvl == "High Risk").alias("high_risk_claims"),
                      count_if(lvl == "Medium Risk").alias("medium_risk_claims"),
                      count_if(lvl == "Low Risk").alias("low_risk_claims"),
                      F.sum("claim_amount").alias("__amt"), F.count("claim_amount").alias("__n"),
                      F.sum("fraud_probability").alias("__p"), F.count("fraud_probability").alias("__np"))
                 .select(F.to_date(F.col("w.start")).alias("report_date"), "total_claims", "critical_risk_claims",
                         "high_risk_claims", "medium_risk_claims", "low_risk_claims",
                         F.try_divide(F.col("__amt").cast("double"), F.col("__n").cast("double")).alias("avg_claim_amount"),
                         F.col("__amt").cast("decimal(22,2)").alias("total_claim_amount"),
                         F.try_divide(F.col("__p").cast("double"), F.col("__np").cast("double"))
                          .alias("avg_fraud_probability")))
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ST3
def stream_dashboard(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str) -> None:
    preds = read_stream(spark, source, schema)
    counters = (preds.groupBy("risk_level")
                     .agg(F.count(F.lit(1)).alias("count"), F.sum("fraud_probability").alias("__p"),
                          F.count("fraud_probability").alias("__n"))
                     .select("risk_level", "count",
                             F.coalesce(F.try_divide(F.col("__p").cast("double"), F.col("__n").cast("double")),
                                        F.lit(0.0)).alias("avg_probability")))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))

    q = (counters.writeStream.outputMode("complete").foreachBatch(publish)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def last_dashboard(spark: SparkSession, sink: str) -> DataFrame:
    """The counters as of the last micro-batch."""
    published = spark.read.parquet(sink)
    last = published.agg(F.max("batch")).first()[0]
    return published.where(F.col("batch") == last).drop("batch")


# Registered end-to-end runs over the driver tables -------------------------------------------------

def _feed_files(df: DataFrame, minimum: int = 4, rows_per_file: int = 5_000_000) -> int:
    """Number of arriving batches for a staged feed: at least ``minimum``, ~5M rows each."""
    return max(minimum, -(-df.count() // rows_per_file))


def run_stream_score(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    claims = materialize(op.claims_table(spark, sf_dir), "streamed_claims")
    base = _scratch(spark, "score")
    history = claims.select("patient_id", "patient_total_claims", "patient_provider_count").distinct()
    history.write.mode("overwrite").parquet(os.path.join(base, "history"))
    arriving = claims.drop("patient_total_claims", "patient_provider_count")
    src = os.path.join(base, "in")
    feed_and_run(arriving, src, files or _feed_files(arriving), "submission_date",
                 lambda: stream_score_claims(spark, src, arriving.schema, os.path.join(base, "history"),
                                             os.path.join(base, "out"), os.path.join(base, "ckpt")))
    return spark.read.parquet(os.path.join(base, "out")).drop("batch")


def fit_state(spark: SparkSession, claims: DataFrame, root: str, preset: str | dict = "very_conservative") -> ScoringState:
    """Fit statistics and a model on merged claim rows and publish both."""
    cleaned = materialize(pl.clean_claims(claims), "state_claims")
    stats = ClaimStats.fit(cleaned)
    ft = pl.finalize_features(pl.with_claim_features(cleaned, stats))
    features = [c for c in ft.columns if c != "PotentialFraud"]
    rows = materialize(ft.select(F.col("PotentialFraud").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in features]), "state_rows")
    publish_state(spark, root, stats, ml.fit(ml.gbt_pipeline(features, preset), mt.with_class_weight(rows, "label")), features)
    return load_state(spark, root)


def run_stream_by_model(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    merged = materialize(pl.merged_claims(spark, sf_dir).where(F.col("ClaimID").isNotNull()), "streamed_merged")
    base = _scratch(spark, "model")
    state = os.path.join(base, "state")
    fit_state(spark, merged, state)
    arriving = merged.drop("PotentialFraud")
    src = os.path.join(base, "in")
    feed_and_run(arriving, src, files or _feed_files(arriving), "ClaimStartDt",
                 lambda: stream_score_by_model(spark, src, arriving.schema, state, os.path.join(base, "out"), os.path.join(base, "ckpt")))
    return spark.read.parquet(os.path.join(base, "out")).drop("batch")


def run_stream_daily(spark: SparkSession, sf_dir: str, files: int | None = None, delay: str = "1 day") -> DataFrame:
    c, p, _ = op.operational_tables(spark, sf_dir, ())
    rows = c.select("claim_id", "submission_date", "claim_amount").join(
        p.select("claim_id", "risk_level", "fraud_probability"), "claim_id", "left")
    base = _scratch(spark, "daily")
    src = os.path.join(base, "in")
    feed_and_run(rows, src, files or _feed_files(c), "submission_date",
                 lambda: stream_daily_summary(spark, src, rows.schema, os.path.join(base, "out"),
                                              os.path.join(base, "ckpt"), delay))
    return spark.read.parquet(os.path.join(base, "out"))


def run_stream_dashboard(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    p = materialize(op.predictions_table(spark, sf_dir).select("prediction_id", "risk_level", "fraud_probability"),
                    "streamed_predictions")
    base = _scratch(spark, "dash")
    src = os.path.join(base, "in")
    feed_and_run(p, src, files or _feed_files(p), None,
                 lambda: stream_dashboard(spark, src, p.schema, os.path.join(base, "out"), os.path.join(base, "ckpt")))
    return last_dashboard(spark, os.path.join(base, "out"))
