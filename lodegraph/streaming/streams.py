"""Structured Streaming over commits, status events and driver events. State is bounded by watermarks; sinks are tables in
shared storage, so a lost executor or driver resumes from the checkpoint that the query names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodegraph.functions.scores import FEATURE_STEPS


def new_commits(commits: DataFrame, delay: str = "7 days") -> DataFrame:
    """Commits (sha, at ...) once each; a sha is forgotten when the watermark passes it by `delay`."""
    return commits.withWatermark("at", delay).dropDuplicatesWithinWatermark(["sha"])


def feature_states(events: DataFrame) -> DataFrame:
    """feature, status, moves, refused: the machine of features fed by events (feature, at, status). A feature begins in
    planning; a step that isn't legal is counted and changes nothing. State is two numbers and a word a feature."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, moves, refused = state.get if state.exists else ("planning", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "status"])
        for to in rows["status"]:
            if (status, to) in FEATURE_STEPS:
                status, moves = to, moves + 1
            elif to != status:
                refused += 1
        state.update((status, moves, refused))
        yield pd.DataFrame({"feature": [key[0]], "status": [status], "moves": [moves], "refused": [refused]})

    return events.groupBy("feature").applyInPandasWithState(run, "feature string, status string, moves long, refused long", "status string, moves long, refused long", "update", GroupStateTimeout.NoTimeout)


def cochange_to_table(touches: DataFrame, path: str, checkpoint: str, max_files: int = 50) -> StreamingQuery:
    """Co-change counts kept up to date in a table of versions below `path`: each batch of touches (sha, path; a commit's
    rows arrive together) is counted, added to the last version's counts and written as the next one. A batch that is
    replayed finds its version written and does nothing."""
    from lodegraph.operators.graph import co_occurring

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        there = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n:08d}/_SUCCESS"))
        if there(number):
            return
        new = co_occurring(batch, "sha", "path", 1, max_files)
        if number and there(number - 1):
            new = spark.read.parquet(f"{path}/v={number - 1:08d}").unionByName(new).groupBy("a", "b").agg(F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(f"{path}/v={number:08d}")

    return touches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows over events (ts, event_type, value); events later than
    `delay` behind the newest are dropped from closed windows, as watermarks do."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of sessions: events of a user less than `gap` apart."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def event_log(events: DataFrame, table: str, log: str, checkpoint: str) -> StreamingQuery:
    """Events appended to a table and to a JSON log; a replayed batch overwrites its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.write.mode("overwrite").parquet(f"{table}/batch={number:08d}")
        kept.write.mode("overwrite").json(f"{log}/batch={number:08d}")
        kept.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
