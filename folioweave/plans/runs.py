"""Runs and batches as append-only rows: identity, state, and counts; a book's failure is a row."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.config import ProcessingConfig, config_hash


def run_id(input_hash: str, config: ProcessingConfig, now: datetime.datetime | None = None) -> str:
    now = now or datetime.datetime.now(datetime.timezone.utc)
    return f"{now:%Y%m%dT%H%M%SZ}-{input_hash[:8]}-{config_hash(config)[:8]}"


def selection_hash(paths: list[str]) -> str:
    return hashlib.sha256(json.dumps(sorted(paths), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def latest_states(events: DataFrame) -> DataFrame:
    """(run_id, state, at, error): the last event of each run, created < running < succeeded or failed on equal times."""
    order = F.when(F.col("state") == "created", 0).when(F.col("state") == "running", 1).otherwise(2)
    by = Window.partitionBy("run_id").orderBy(F.desc("at"), order.desc())
    return events.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def batch_counts(results: DataFrame) -> DataFrame:
    """(batch_id, total, succeeded, failed, skipped) of the books of a batch."""
    return results.groupBy("batch_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("succeeded", "failed", "skipped")])
