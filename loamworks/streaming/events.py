"""Event streams: publishing, subscribing by job, progress and completion."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "job_id string, layer string, event_type string, agent_name string, message string, metadata map<string, string>, at timestamp"
LAYERS = ("parse", "detection")


def decode(raw: DataFrame, c: str = "value") -> DataFrame:
    """Events from JSON text; malformed rows, and those without layer or type, are left out."""
    df = raw.select(F.from_json(c, EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return df.where("layer IS NOT NULL AND event_type IS NOT NULL")


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under a folder: publishing is appending a file, and late subscribers see all of it."""
    return spark.readStream.schema(EVENT).parquet(path)


def subscribe(events: DataFrame, job_id: str) -> DataFrame:
    """One job's events; jobs never see each other's."""
    return events.where(F.col("job_id") == job_id)


def progress(events: DataFrame) -> DataFrame:
    """Per job and layer: events so far, and whether the layer is complete. For update or complete mode, or a batch."""
    shown = F.col("event_type") != "layer_complete"
    return events.groupBy("job_id", "layer").agg(F.count_if(shown).alias("events"), F.bool_or(~shown).alias("done"))


def activity(events: DataFrame) -> DataFrame:
    """What a reader of the log is shown: all but completion marks."""
    return events.where("event_type <> 'layer_complete'")


def _until_complete(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    done = state.exists and state.get[0]
    out = []
    parts = list(rows)  # Arrow cuts a job's events into parts in no order of time
    for row in pd.concat(parts).sort_values("at", kind="stable").itertuples(index=False) if parts else ():
        if not done:
            out.append((key[0], row.layer, row.event_type, row.message))
            done = row.event_type == "pipeline_complete"
    state.update((done,))
    yield pd.DataFrame(out, columns=["job_id", "layer", "event_type", "message"])


def until_complete(events: DataFrame) -> DataFrame:
    """Each job's events up to its completion; what comes later is dropped. State: one flag a job.

    A task holds the events that one job has in one micro-batch; sources bound those by files per trigger.
    """
    return events.groupBy("job_id").applyInPandasWithState(_until_complete, "job_id string, layer string, event_type string, message string", "done boolean", "append", "NoTimeout")


def watched(events: DataFrame) -> DataFrame:
    """What subscribers of jobs are sent of a finished log: a `connected` row a job, then its events up to the first completion.

    Events need a time; those with a null one, and those of the completion's own time, are sent too.
    """
    first = events.groupBy("job_id").agg(F.min(F.when(F.col("event_type") == "pipeline_complete", F.col("at"))).alias("_end"))
    sent = events.join(first, "job_id").where("_end IS NULL OR at IS NULL OR at <= _end").drop("_end")
    return first.select("job_id", F.lit("connected").alias("event_type")).unionByName(sent, allowMissingColumns=True)


def publish(events: DataFrame, path: str) -> None:
    """Appends events to the log under a folder, where `source` finds them."""
    events.write.mode("append").parquet(path)


def counts_by_window(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: events by job and time window, with a bound on lateness that keeps state small."""
    return events.withWatermark("at", late).groupBy("job_id", F.window("at", width)).agg(F.count("*").alias("n"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; unset, a temporary one where there is no other machine, and an error elsewhere."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors of {master or 'the cluster'} share")
    path = tempfile.mkdtemp(prefix="loamworks-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, and returns what it wrote with the number of its micro-batch, `batch`.

    Rows and offsets go to a folder that driver and executors share, so a stopped run goes on where
    it was; a micro-batch that runs again writes its folder anew. Under `update` a key's last row is
    that of its highest batch.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/loamworks/{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(f"{root}/rows")
