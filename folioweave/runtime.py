"""Session-level helpers shared by every operator: table access, row identity, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One table of a data folder; ``columns`` prunes the scan."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def once_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key.

    Rows repeated under one key agree in everything but arrival columns, so any of them
    stands for the fact; arrival columns are dropped by the caller's column choice.
    """
    return df.dropDuplicates(list(keys))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset on a single machine
    (tests) a folder of our own is made, as executors elsewhere could not read it.
    """
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not there and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="folioweave-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    A checkpointed plan still carries the constraints that were known of its columns. In a loop of self joins
    each round would take over, rename and combine those of the round before, until the driver's
    memory is full of them; so the result is built anew from the stored rows and their schema alone.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    stored = df.checkpoint(eager=eager)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(stored.queryExecution().toRdd(), stored.schema(), False), spark)


def cut_table(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared checkpoint folder and read from there.

    For what many passes read, each its own columns: a table is read column by column, where a cut is
    read row by row and whole. The files stay until the folder is cleaned.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounds_for(n: int | None) -> int:
    """Doubling rounds that cover chains of ``n`` links."""
    return max(1, int(n or 1).bit_length())


def is_number(c: Column | str) -> Column:
    """Neither null nor NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)
