"""Micro-batches with several sinks and a state table, all written by batch number.

A step gets a batch and the state before it, and returns tables for the sinks and the keys whose state has changed. Every
table goes to a folder of its batch's number and replaces what is there: a batch that failed half way is run again from the
stream's checkpoint with the same number, reads the same state and overwrites what it had left, so each sink has each row
once. The state is kept as changes by batch number, which are put together every so many batches; keys that were not seen
for the time to live are forgotten then. Steps are DataFrame code: a hot key is sorted by Spark, which spills, and no state
or group passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesieve.functions.shared import new_folder, shared_folder
from sitesieve.streaming.events import ENVELOPE, RETRYABLE, parse

#: Batches after which changes of the state are put together.
COMPACTED = 10

Step = Callable[[DataFrame, DataFrame | None], tuple[dict[str, DataFrame], DataFrame | None]]


class State:
    """The last row of each key, below ``folder``. ``schema`` has the keys, what is kept of them, and ``seen_at``."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], schema: str, ttl: str | None = None, compacted: int = COMPACTED):
        self.spark, self.folder, self.keys, self.schema, self.ttl, self.compacted = spark, folder, keys, schema, ttl, compacted

    def before(self, batch: int) -> DataFrame:
        """The state that batch number ``batch`` starts from."""
        last = (batch - 1) // self.compacted * self.compacted if batch > 0 else 0
        whole = [f"{self.folder}/whole-{last}"] if last else []
        paths = whole + [f"{self.folder}/changes-{k}" for k in range(last, batch)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        each = [self.spark.read.schema(self.schema).parquet(p).withColumn("_age", F.lit(k)) for k, p in enumerate(paths)]
        rows = each[0]
        for df in each[1:]:
            rows = rows.unionByName(df)
        kept = [c for c in rows.columns if c not in (*self.keys, "_age")]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*kept), "_age").alias("s")).select(*self.keys, "s.*")

    def write(self, batch: int, before: DataFrame, changed: DataFrame) -> None:
        if batch and batch % self.compacted == 0:
            newest = before.agg(F.max("seen_at")).first()[0]
            alive = before if self.ttl is None or newest is None else before.filter(F.col("seen_at") >= F.lit(newest) - F.expr(f"interval {self.ttl}"))
            alive.write.mode("overwrite").parquet(f"{self.folder}/whole-{batch}")
        changed.write.mode("overwrite").parquet(f"{self.folder}/changes-{batch}")


def process(stream: DataFrame, folder: str, step: Step, state: State | None = None) -> None:
    """Run ``step`` over all that is there now; sinks are ``folder``/name, the checkpoint is ``folder``/checkpoint."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        before = state.before(number) if state else None
        sinks, changed = step(rows, before)
        for name, df in sinks.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        if state:
            state.write(number, before, changed)
        rows.unpersist()

    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def sink(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """What a sink holds, of all batches."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}").drop("batch")


def change_step(batch: DataFrame, before: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Updates (url, content_hash, at) whose hash differs from the url's last one, in the order of ``at``. State: url, last, seen_at."""
    order = Window.partitionBy("url").orderBy("at")
    rows = batch.select("url", "content_hash", "at").join(before.select("url", "last"), "url", "left")
    rows = rows.withColumn("previous_hash", F.when(F.row_number().over(order) == 1, F.col("last")).otherwise(F.lag("content_hash").over(order)))
    changed = rows.filter(~F.col("content_hash").eqNullSafe(F.col("previous_hash"))).select("url", "previous_hash", "content_hash", "at")
    return {"changes": changed}, batch.groupBy("url").agg(F.max_by("content_hash", "at").alias("last"), F.max("at").alias("seen_at"))


CHANGE_STATE, CHANGES = "url string, last string, seen_at timestamp", "url string, previous_hash string, content_hash string, at timestamp"


def claim_step(batch: DataFrame, before: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Attempts to deliver (channel_id, id, at, status) that are let through: none after one that succeeded or failed for good.
    State: channel_id, id, taken, seen_at."""
    keys = ["channel_id", "id"]
    final = (F.col("status").isNotNull() & ~F.col("status").isin(*RETRYABLE)).cast("int")  # a failure that may be tried again releases it
    earlier = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = batch.select(*keys, "at", "status").join(before.select(*keys, "taken"), keys, "left")
    through = rows.withColumn("_done", F.coalesce(F.sum(final).over(earlier), F.lit(0))).filter(~F.coalesce("taken", F.lit(False)) & (F.col("_done") == 0))
    state = rows.groupBy(*keys).agg((F.bool_or(F.coalesce("taken", F.lit(False))) | (F.max(final) > 0)).alias("taken"), F.max("at").alias("seen_at"))
    return {"attempts": through.select(*keys, "at")}, state


CLAIM_STATE, ATTEMPTS = "channel_id string, id string, taken boolean, seen_at timestamp", "channel_id string, id string, at timestamp"


def letter_step(batch: DataFrame, _: DataFrame | None) -> tuple[dict[str, DataFrame], None]:
    """Envelopes (column value) that are sound, and the texts of those that aren't."""
    parsed = parse(batch)
    return {"events": parsed.filter("not malformed").drop("value", "malformed"), "dead": parsed.filter("malformed").select(F.col("value").cast("string").alias("value"))}, None


def fanout_step(done: Column) -> Step:
    """Of finished crawls' pages (site, url, content_hash, indexable) an update for each indexable page, and one completion for each row that
    is ``done``."""

    def step(batch: DataFrame, _: DataFrame | None) -> tuple[dict[str, DataFrame], None]:
        updates = batch.filter("indexable").select("site", F.lit("page.updated").alias("type"), F.col("url").alias("subject"), "content_hash")
        return {"updates": updates, "completions": batch.filter(done).select("site", F.lit("crawl.completed").alias("type"), F.col("site").alias("subject"))}, None

    return step


EVENTS, DEAD = ENVELOPE, "value string"
UPDATES, COMPLETIONS = "site string, type string, subject string, content_hash string", "site string, type string, subject string"


def run(stream: DataFrame, name: str, step: Step, keys: tuple[str, ...] = (), schema: str = "", ttl: str | None = None) -> str:
    """``process`` in a new folder of the shared one, with a state where ``keys`` are given; the folder."""
    spark = stream.sparkSession
    shared_folder(spark)
    folder = new_folder(spark, name)
    process(stream, folder, step, State(spark, f"{folder}/state", keys, schema, ttl) if keys else None)
    return folder
