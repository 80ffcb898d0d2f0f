"""Structured Streaming jobs: triggers, once-only alerts, limits and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moraine.sources.workspace import workspace

SENSOR_KINDS = ("water_level_drop", "flow_surge", "manual")
LIMIT, SPAN_S = 10, 60
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, name: str, files_each: int = 1) -> DataFrame:
    """Parquet files of ``path`` whose name matches, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", name).parquet(path)


def run_to_end(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet in the shared folder and read what it wrote."""
    spark = stream.sparkSession
    out, state = workspace(spark, tag), workspace(spark, f"{tag}-state")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def sensor_events(readings: DataFrame) -> DataFrame:
    """Readings of a known kind with both ids; the rest are dropped at the door."""
    return readings.where(F.col("kind").isin(*SENSOR_KINDS) & F.col("lake_id").isNotNull() & F.col("sensor_id").isNotNull())


def fan_out(readings: DataFrame, recipients: DataFrame) -> DataFrame:
    """Stream-static join: every recipient of the lake, for every reading."""
    return sensor_events(readings).join(recipients, "lake_id")


def once_per_scene(looks: DataFrame, delay: str = "30 days") -> DataFrame:
    """An alert once a lake and scene, however often the scene is seen again."""
    return looks.withWatermark("at", delay).dropDuplicatesWithinWatermark(["lake_id", "scene_id"])


def isolated(rows: DataFrame, stage: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """(lake_id, reason, out): ``stage`` over each lake's rows, as structs of ``schema``; a lake that fails is one row with its reason.

    A lake is a group: its rows, which its seasons bound, are one frame.
    """
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lake = pdf["lake_id"].iloc[0]
        try:
            done = stage(pdf)
            values = [dict(zip(names, row, strict=True)) for row in done[names].itertuples(index=False, name=None)]
            return pd.DataFrame({"lake_id": [lake] * len(done), "reason": None, "out": values})
        except Exception as error:  # noqa: BLE001 - any failure of a lake is its own
            return pd.DataFrame({"lake_id": [lake], "reason": [f"{type(error).__name__}: {error}"], "out": [None]})

    kind = rows.schema["lake_id"].dataType.simpleString()
    inner = T.StructType.fromDDL(schema).simpleString()
    return rows.groupBy("lake_id").applyInPandas(run, f"lake_id {kind}, reason string, out {inner}")


def refresh(looks: DataFrame, stages: list[tuple[str, Callable[[pd.DataFrame], pd.DataFrame], str]], tag: str) -> tuple[DataFrame, DataFrame]:
    """A stream of ``looks(lake_id, ...)`` through ordered stages, drained to the end: the last stage's rows, and (lake_id, stage, reason) of what failed.

    Each stage is (name, function of a lake's rows, schema of its result, lake_id among it) and takes what the stage before
    made. A lake that fails in one is left out of the later ones; all others go on. A batch writes over itself, so one that is run again leaves nothing twice.
    """
    spark = looks.sparkSession
    out, state = workspace(spark, tag), workspace(spark, f"{tag}-state")

    def batch(df: DataFrame, n: int) -> None:
        for name, stage, schema in stages:
            path = f"{out}/{name}/batch={n}"
            isolated(df, stage, schema).write.mode("overwrite").parquet(path)
            df = df.sparkSession.read.parquet(path).where("reason is null").select("out.*")

    looks.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    kind = looks.schema["lake_id"].dataType.simpleString()
    written = [spark.read.schema(f"lake_id {kind}, reason string, out {T.StructType.fromDDL(schema).simpleString()}").parquet(f"{out}/{name}").select("*", F.lit(name).alias("stage")) for name, _, schema in stages]
    failed = [w.where("reason is not null").select("lake_id", "stage", "reason") for w in written]
    return written[-1].where("reason is null").select("out.*"), reduce(DataFrame.unionByName, failed)


class LastScene(StatefulProcessor):
    """One lake's drained looks in order: each scene other than the last alerted one raises an alert, and becomes the last.

    The state is one scene a lake, written with the batch that delivers the alert: a batch that is run again
    starts from the state before it, and gives the same alerts. An older scene raises again once another one was alerted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "scene_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        looks = pd.concat(list(rows)).sort_values(["seq"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        scenes = looks["scene_id"].to_numpy()
        fresh = scenes != pd.Series(scenes, dtype=object).shift(1, fill_value=last).to_numpy()
        self.last.update((str(scenes[-1]),))
        yield pd.DataFrame({"lake_id": key[0], "scene_id": scenes[fresh], "seq": looks["seq"].to_numpy()[fresh]})

    def close(self) -> None:
        pass


def alert_last_scene(looks: DataFrame, tag: str) -> DataFrame:
    """Alerts of ``looks(lake_id, scene_id string, seq, drained)`` that name a scene, drained to the end: (lake_id, scene_id, seq)."""
    spark = looks.sparkSession
    rows = looks.where(F.coalesce("drained", F.lit(False)) & (F.coalesce("scene_id", F.lit("")) != "")).select("lake_id", "scene_id", "seq")
    out = f"lake_id {looks.schema['lake_id'].dataType.simpleString()}, scene_id string, seq {looks.schema['seq'].dataType.simpleString()}"
    was = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)  # value states live in this store alone
    try:
        return run_to_end(rows.groupBy("lake_id").transformWithStateInPandas(LastScene(), out, "append", "None"), tag)
    finally:
        spark.conf.unset(STATE_STORE) if was is None else spark.conf.set(STATE_STORE, was)


def tumbling(events: DataFrame, width: str, delay: str, *key: str) -> DataFrame:
    return events.withWatermark("at", delay).groupBy(F.window("at", width), *key).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def sliding(events: DataFrame, width: str, step: str, delay: str, *key: str) -> DataFrame:
    return events.withWatermark("at", delay).groupBy(F.window("at", width, step), *key).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def sessions(events: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    return events.withWatermark("at", delay).groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def _admit(times: list[float], kept: list[float], limit: int, span: float) -> tuple[list[bool], list[float]]:
    """Which of the ordered ``times`` pass; those denied are not remembered."""
    passed = []
    for t in times:
        kept = [k for k in kept if t - k < span]
        passed.append(len(kept) < limit)
        if passed[-1]:
            kept.append(t)
    return passed, kept


def rate_limited(requests: DataFrame, limit: int = LIMIT, span_s: float = SPAN_S) -> DataFrame:
    """``requests(client, request_id, at_s)`` with a flag; the state is at most ``limit`` times a client."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at_s", "request_id"])
        kept = list(state.get[0]) if state.exists else []
        passed, kept = _admit(rows["at_s"].tolist(), kept, limit, span_s)
        state.update((kept,))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"].to_numpy(), "passed": passed})

    grouped = requests.groupBy("client")
    return grouped.applyInPandasWithState(step, "client long, request_id long, passed boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def upsert_events(batch: DataFrame, path: str) -> None:
    """Idempotent event log: one file set a batch, so a repeated batch replaces itself."""
    w = Window.partitionBy("event_id").orderBy(F.desc("version"))
    batch.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").write.mode("overwrite").parquet(path)


def log_events(stream: DataFrame, tag: str) -> DataFrame:
    """Write-ahead event log through ``foreachBatch``, the newest version of an event winning."""
    spark = stream.sparkSession
    out, state = workspace(spark, tag), workspace(spark, f"{tag}-state")
    q = stream.writeStream.foreachBatch(lambda df, n: upsert_events(df, f"{out}/batch={n}")).option("checkpointLocation", state)
    q.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
    w = Window.partitionBy("event_id").orderBy(F.desc("version"))
    return log.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
