"""Where tables come from: files found by name, plans and review items in JSON, manifests."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLAN_JSON = "title string, level int, pdf_page int, source string, confidence double, evidence array<string>"


def glob_pattern(globs: tuple[str, ...]) -> str:
    """A regular expression that matches what any of the globs does, without case."""
    return "(?i)" + "|".join(f"(?:{translate(g.lower())})" for g in globs)


def discover(
    spark: SparkSession, folder: str, suffix: str = ".pdf", recursive: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), skip: str | None = None, hashed: bool = True
) -> DataFrame:
    """(path, relative, size, sha256) of the files of a folder, in order of their relative path.

    Names are compared before any file is read: globs without case, with the relative path and with the bare name; any include admits
    and any exclude refuses. Files under ``skip`` are left out; ``skip`` must not be the folder itself. Without ``hashed`` no file is read
    and there is no sha256.
    """
    if skip is not None and skip.strip("/") in ("", "."):
        raise ValueError("the output folder must not be the input folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = f"file:{folder.rstrip('/')}/" if "://" not in folder else folder.rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + re.escape(root.replace("file://", "file:/")), "")
    rows = files.withColumn("relative", relative).where(F.lower("relative").endswith(suffix.lower()))
    if not recursive:
        rows = rows.where(~F.col("relative").contains("/"))
    if skip:
        rows = rows.where(~F.col("relative").startswith(skip.rstrip("/") + "/"))
    name = F.substring_index("relative", "/", -1)
    for globs, wanted in ((include, True), (exclude, False)):
        if globs:
            hit = F.col("relative").rlike(glob_pattern(globs)) | name.rlike(glob_pattern(globs))
            rows = rows.where(hit if wanted else ~hit)
    out = ["path", "relative", F.col("length").alias("size"), *([F.sha2("content", 256).alias("sha256")] if hashed else [])]
    return rows.select(*out).orderBy(F.lower("relative"), "relative")


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, faulty rows with ``error``) of plan items in JSON lines; a fault never ends the job.

    A title is a string that isn't blank, level and page are whole numbers, a source is a string, a confidence a number and
    evidence a list of strings; the last three may be missing. A value of another kind is a fault, not converted.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    rows = raw.withColumn("v", F.try_parse_json("value")).withColumn("item", F.from_json("value", PLAN_JSON))
    whole = lambda k: kind(k).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    missing = lambda k: F.coalesce(kind(k).isin("VOID"), F.lit(True))
    error = (
        F.when(F.col("v").isNull() | ~F.trim("value").startswith("{"), "not a plan item")
        .when(~F.coalesce(kind("title") == "STRING", F.lit(False)) | (F.coalesce(F.trim("item.title"), F.lit("")) == ""), "blank title")
        .when(~F.coalesce(whole("level") & whole("pdf_page"), F.lit(False)), "level or page missing")
        .when(~missing("source") & (kind("source") != "STRING"), "source is no text")
        .when(~missing("confidence") & ~whole("confidence") & ~kind("confidence").rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), "confidence is no number")
        .when(~missing("evidence") & ~kind("evidence").isin("ARRAY<STRING>", "ARRAY<VOID>"), "evidence is no list of texts")
    )
    marked = rows.withColumn("error", error)
    return marked.where("error is null").select("item.*"), marked.where("error is not null").select("error", F.col("value").alias("row"))


def first_manifest(candidates: DataFrame) -> DataFrame:
    """Of a run's manifests (run, priority, path) the one of the highest priority, then the first path; ``more`` tells of others."""
    by = Window.partitionBy("run").orderBy("priority", "path")
    n = F.count("*").over(Window.partitionBy("run"))
    return candidates.withColumn("r", F.row_number().over(by)).withColumn("more", n > 1).where("r = 1").drop("r")


def manifest_candidates(spark: SparkSession, folder: str, names: tuple[str, ...] = ("markdown_manifest.json", "manifest.json")) -> DataFrame:
    """(run, priority, path) of the manifests below a folder: the run is the folder that holds it, the first name goes first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    name = F.substring_index("path", "/", -1)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return files.select("path", place.alias("priority")).where("priority > 0").select(F.regexp_replace("path", "/[^/]*$", "").alias("run"), "priority", "path")
