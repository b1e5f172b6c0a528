"""Runs of several stages that can be taken up again.

A run has a name; each stage's rows are a folder of their own, stage/run_id=name, so that a stage's runs are the
partitions of one table.  A stage that is complete (its folder has the writer's mark of success) is read instead of made
again; one that was broken off is overwritten as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..plans import classify as C
from .stores import _child, _hadoop, merge_frames, with_scheme


class Run:
    """The stages of one run in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str) -> None:
        if not run_id or "/" in run_id:
            raise ValueError("a run needs a name without a slash")
        self.spark, self.folder, self.run_id = spark, folder.rstrip("/"), run_id
        self.made: list[str] = []

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}/run_id={self.run_id}"

    def done(self, stage: str) -> bool:
        fs, path = _hadoop(self.spark, self.path(stage))
        return fs.exists(_child(self.spark, self.path(stage), "_SUCCESS")) if fs.exists(path) else False

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows: those that are there if it is complete, else what ``make`` gives, written first."""
        if not self.done(name):
            make().write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
            self.made.append(name)
        return self.spark.read.parquet(self.path(name))


def read_stage(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """The rows of all runs of a stage, with their run_id; none if there is no such stage."""
    try:
        return spark.read.option("basePath", f"{folder}/{stage}").parquet(f"{folder}/{stage}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "run_id string")


def capture_jobs(captures: DataFrame, brand: str | None = None) -> DataFrame:
    """Jobs (job_id, url, html, ...) of captures as stores.read_captures() gives them; frames are merged into their pages."""
    name = F.lit(brand).cast("string")
    return captures.select(
        F.col("host").alias("job_id"),
        with_scheme(F.coalesce("final_url", "host")).alias("url"),
        merge_frames(F.col("html"), F.coalesce("iframes", F.array().cast(captures.schema["iframes"].dataType))).alias("html"),
        "rendered_text",
        "http_status",
        name.alias("user_input"),
    )


#: What is known about a job besides its pages, and is kept with its result.
RESULT = ("job_id", "path", "label", "confidence", "classified_as", "scores", "fired_rules", "signals")


def analyse(run: Run, jobs: Callable[[], DataFrame], tables: Mapping[str, object]) -> DataFrame:
    """The results of all jobs, by stages: 00_meta, 02_capture (the jobs), 08_kbs (all that classify() gives) and 10_result.

    ``tables`` are those that classify() takes.  Called again after a failure it goes on with the first stage that isn't complete.
    """
    run.stage("00_meta", lambda: run.spark.createDataFrame([(run.run_id, sorted(k for k, v in tables.items() if v is not None))], "name string, tables array<string>"))
    captured = run.stage("02_capture", jobs)
    judged = run.stage("08_kbs", lambda: C.classify(captured, **tables).select(*RESULT))
    return run.stage("10_result", lambda: result_rows(judged))


def result_rows(judged: DataFrame) -> DataFrame:
    """(job_id, label, confidence, path, classified_as, fired_rules): a result without the nested stages."""
    return judged.select("job_id", reports.normalize_label(F.col("label")).alias("label"), "confidence", "path", F.array_join("classified_as", ",").alias("classified_as"), F.array_join("fired_rules", ",").alias("fired_rules"))
