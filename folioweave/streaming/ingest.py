"""Books that arrive over time: each batch of new lines goes through the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioweave.config import TypographyConfig
from folioweave.operators.lines import line_rows
from folioweave.plans.pipeline import infer


def watch_lines(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def infer_new_books(lines: DataFrame, out: str, checkpoint: str, config: TypographyConfig = TypographyConfig()) -> StreamingQuery:
    """Writes the plan of each batch's books under ``out``, one folder for each batch, so that a repeated batch replaces itself."""

    def batch(df: DataFrame, n: int) -> None:
        infer(line_rows(df), config).plan.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(lines: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Lines for each book and day of making, late ones up to the watermark."""
    return lines.withWatermark("processed_at", late).groupBy(F.window("processed_at", window), "book_id").agg(F.count("*").alias("lines"))
