"""Event logs as streams: envelopes checked, duplicates dropped, state folded.

Every function takes a streaming or a batch DataFrame where Spark allows both; ``drain`` runs a stream over all that
is there, into a table of the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.functions.shared import shared_folder

#: Fields that an envelope must have.
REQUIRED = ("id", "type", "version", "occurred_at", "producer", "payload")
ENVELOPE = "id string, type string, version int, occurred_at timestamp, producer string, correlation_id string, causation_id string, tenant_id string, project_id string, payload string"
#: Statuses of a delivery that may be tried again.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
WATERMARK = "1 day"


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes from JSON text; ``malformed`` where a required field is missing or the text is no JSON."""
    parsed = raw.withColumn("e", F.from_json(F.col(column).cast("string"), ENVELOPE))
    missing = ~F.forall(F.array(*(F.col(f"e.{f}").cast("string") for f in REQUIRED)), lambda x: x.isNotNull())
    return parsed.withColumn("malformed", F.coalesce(missing, F.lit(True))).select(column, "malformed", "e.*")


def split_dead_letters(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    return batch.filter("not malformed"), batch.filter("malformed")


def route(events: DataFrame, pattern: str) -> DataFrame:
    """Events of the types that a topic pattern names: ``*`` is one word, ``#`` any words."""
    words = [{"*": r"[^.]+", "#": r".*"}.get(w, r"\Q" + w + r"\E") for w in pattern.split(".")]
    return events.filter(F.col("type").rlike("^" + r"\.".join(words) + "$"))


def dedup(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each event id once; the state is kept as long as the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(["id"])
    return events.withWatermark("occurred_at", watermark).dropDuplicatesWithinWatermark(["id"])


def wants(active: Column, types: Column, event_type: Column) -> Column:
    """Whether a channel takes an event: not when inactive, any with an empty list, else the listed ones."""
    return F.when(~active, False).when(F.size(types) == 0, True).otherwise(F.array_contains(types, event_type))


def retryable(status: Column) -> Column:
    return status.isNull() | status.isin(*RETRYABLE)


def deliveries(channels: DataFrame, events: DataFrame) -> DataFrame:
    """Events fan out to the subscribed channels of the same tenant; no tenant is one tenant."""
    both = events.join(channels.withColumnRenamed("tenant_id", "_tenant"), events["tenant_id"].eqNullSafe(F.col("_tenant")))
    return both.filter(wants(F.col("active"), F.col("events"), F.col("type"))).select("channel_id", "id", "type", "tenant_id")


def fold_steps(completions: DataFrame) -> DataFrame:
    """State of each step of a run: the first completion counts, later ones change nothing. A streaming aggregate."""
    first = F.min(F.struct("occurred_at", "status"))
    return completions.groupBy("run_id", "job_id").agg(first.alias("f"), F.count(F.lit(1)).alias("seen")).select("run_id", "job_id", F.col("f.status").alias("status"), F.col("f.occurred_at").alias("completed_at"), "seen")


def run_status(steps: DataFrame) -> DataFrame:
    """failed if a step that isn't optional failed, completed if none is pending or dispatched, else running."""
    failed = F.bool_or((F.col("status") == "failed") & ~F.coalesce("optional", F.lit(False)))
    open_ = F.bool_or(F.col("status").isin("pending", "dispatched"))
    return steps.groupBy("run_id").agg(F.when(failed, "failed").when(open_, "running").otherwise("completed").alias("status"), F.min_by("error", F.when(F.col("status") == "failed", F.col("position"))).alias("error"))


#: Column of the headline, kind of the step, field of its result, type.
HEADLINE = (
    ("overall_score", "crawl", "overall_score", "double"), ("total_issues", "crawl", "total_issues", "bigint"), ("keywords_found", "keyword_research", "total", "bigint"),
    ("keywords_ranked", "serp_check", "keywords_ranked", "bigint"), ("average_position", "serp_check", "average_position", "double"), ("orphan_pages", "link_analysis", "orphan_count", "bigint"),
    ("keyword_coverage", "content_analysis", "coverage", "double"), ("pages_to_rewrite", "optimizer_plan", "pages_with_fixes", "bigint"), ("competitors_compared", "competitor_check", "compared_against", "bigint"),
)


def headline(steps: DataFrame) -> DataFrame:
    """One row for each run of steps (run_id, position, kind, result as JSON text): of each kind the first step with a result counts.

    What no step gave is null; ``behind_on`` counts only where competitors were compared.
    """
    kinds = list(dict.fromkeys(kind for _, kind, _, _ in HEADLINE))
    given = F.col("result").isNotNull() & ~F.trim("result").isin("", "{}", "null")
    first = steps.groupBy("run_id").agg(*(F.min_by("result", F.when(given & (F.col("kind") == k), F.col("position"))).alias(k) for k in kinds))
    behind = F.when(F.col("competitor_check").isNotNull(), F.coalesce(F.json_array_length(F.get_json_object("competitor_check", "$.behind_on")), F.lit(0)).cast("bigint"))
    return first.select("run_id", *(F.get_json_object(kind, f"$.{field}").try_cast(to).alias(name) for name, kind, field, to in HEADLINE), behind.alias("behind_on"))


def match_completions(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Completions of known jobs; a stream against a table."""
    return events.join(steps.select("job_id").distinct(), "job_id", "left_semi")


def trace(events: DataFrame) -> DataFrame:
    """Cause and effect of the same correlation: cause, effect."""
    cause = events.select("correlation_id", F.col("id").alias("causation_id"), F.col("type").alias("cause_type"))
    return events.filter("causation_id is not null").join(cause, ["correlation_id", "causation_id"]).select("correlation_id", F.col("causation_id").alias("cause"), F.col("id").alias("effect"), "cause_type", "type")


def drain(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its output as a table. ``complete`` keeps the last state."""
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = f"{folder}/out"

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(each or write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
