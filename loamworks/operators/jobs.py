"""The job log: appended rows, and views of each job's latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB = "job_id string, seq long, document_name string, status string, at string, intermediate_report string, flaw_report string, recommendations string"
REPORTS = ("intermediate_report", "flaw_report", "recommendations")


def entry(spark: SparkSession, job_id: str, seq: int, status: str, at: str, document_name: str | None = None, **reports: str) -> DataFrame:
    """A row of the log; of `reports` only the known columns are kept."""
    return spark.createDataFrame([(job_id, seq, document_name, status, at, *(reports.get(c) for c in REPORTS))], JOB)


def latest(log: DataFrame) -> DataFrame:
    """Each job's last status, what was last written to each report, and when it was created and completed."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    done = F.col("status").isin("complete", "error")
    return log.groupBy("job_id").agg(
        last("document_name"), F.max_by("status", "seq").alias("status"), F.min_by("at", "seq").alias("created_at"),
        F.max_by("at", F.when(done, F.col("seq"))).alias("completed_at"), *(last(c) for c in REPORTS),
    )


def result(log: DataFrame, job_id: str, schema: str = "faults array<map<string, string>>, faults_found boolean") -> DataFrame:
    """One job's status and decoded findings; no row if there is no such job."""
    return latest(log.where(F.col("job_id") == job_id)).select("job_id", "status", F.from_json("flaw_report", schema)["faults"].alias("faults"))
