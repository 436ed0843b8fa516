"""Size classes by density: valleys or peaks of a kernel estimate over the distinct values of a book.

Sizes are rounded, so a book has few distinct values whatever its number of lines; the estimate
works on (value, count) and is the only part that is not an expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions.text import text_length


def _quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """Linear quantile of repeated values, as of the full list."""
    at = (counts.sum() - 1) * q
    ends = np.cumsum(counts) - 1
    low, high = values[np.searchsorted(ends, np.floor(at))], values[np.searchsorted(ends, np.ceil(at))]
    return float(low + (high - low) * (at - np.floor(at)))


def _deviation(values: np.ndarray, counts: np.ndarray) -> float:
    n = counts.sum()
    if n < 2:
        return 0.0
    mean = (values * counts).sum() / n
    return float(np.sqrt((counts * (values - mean) ** 2).sum() / (n - 1)))


def _density(grid: np.ndarray, values: np.ndarray, counts: np.ndarray, width: float) -> np.ndarray:
    out = np.empty(len(grid))
    for at in range(0, len(grid), 64):  # few places at a time, and in place, so that the numbers stay in the cache
        z = grid[at : at + 64, None] - values[None, :]
        z /= width
        np.multiply(z, z, out=z)
        z *= -0.5
        np.exp(z, out=z)
        z *= counts[None, :]
        out[at : at + 64] = z.sum(axis=1)
    return out


def _midpoints(values: np.ndarray) -> list[float]:
    return [float(x) for x in (values[1:] + values[:-1]) / 2]


def robust_valleys(values: np.ndarray, counts: np.ndarray, points: int = 2048, few: int = 8, fallback: bool = True) -> list[float]:
    """Strict local minima; midpoints where there are few values or no spread (or none, without ``fallback``)."""
    if fallback and len(values) <= few:
        return _midpoints(values)
    if not fallback and (counts.sum() < 3 or np.allclose(values, values[0])):
        return []
    spread = min(_deviation(values, counts), (_quantile(values, counts, 0.75) - _quantile(values, counts, 0.25)) / 1.34)
    width = 0.9 * spread * counts.sum() ** -0.2
    if not width > 0:
        return _midpoints(values) if fallback else []
    grid = np.linspace(values[0], values[-1], points)
    d = _density(grid, values, counts, width)
    inner = (d[:-2] > d[1:-1]) & (d[1:-1] < d[2:])
    return [float(x) for x in grid[1:-1][inner]]


def peak_cuts(values: np.ndarray, counts: np.ndarray, few: int = 8) -> tuple[list[float], list[float]]:
    """(cuts, peaks), ascending: cuts at the least density between neighbouring peaks."""
    if len(values) <= few:
        return _midpoints(values), [float(v) for v in values]
    width = 1.06 * _deviation(values, counts) * counts.sum() ** -0.2
    if not width > 0:
        return [], [_quantile(values, counts, 0.5)]
    grid = np.linspace(values[0] - 1, values[-1] + 1, 1024)
    d = _density(grid, values, counts, width)
    tops = np.flatnonzero((d[:-2] < d[1:-1]) & (d[1:-1] > d[2:])) + 1
    if not len(tops):
        return [], [_quantile(values, counts, 0.5)]
    return [float(grid[a + int(np.argmin(d[a : b + 1]))]) for a, b in zip(tops, tops[1:])], [float(grid[t]) for t in tops]


def merge_sparse(values: np.ndarray, counts: np.ndarray, seen: np.ndarray, cuts: list[float], peaks: list[float], least: int) -> tuple[list[float], list[float]]:
    """The sparsest tier of fewer than ``least`` lines joins the neighbour with the nearer peak, the lower one on a tie, until none is left.

    Lines are counted anew under the cuts of every round; a tier without lines is no sparse one. Of equally sparse tiers the one
    whose first line comes first (``seen``: each value's first place) goes first.
    """
    cuts, peaks = list(cuts), list(peaks)
    while len(peaks) > 1:
        tier = np.searchsorted(cuts, values, side="right")
        there = [(counts[tier == k].sum(), seen[tier == k].min(), k) for k in range(len(peaks)) if (tier == k).any()]
        thin = [t for t in there if t[0] < least]
        if not thin:
            break
        k = min(thin)[2]
        gap = np.diff(peaks)
        a = k if k == 0 or (k < len(gap) and gap[k] < gap[k - 1]) else k - 1
        peaks[a : a + 2] = [(peaks[a] + peaks[a + 1]) / 2]
        cuts = _midpoints(np.array(peaks))
    return cuts, peaks


def _of_books(values: DataFrame, function, first: str | None = None) -> DataFrame:
    """(book_id, cuts, peaks, raw_tiers): ``function(values, counts, seen)`` of every book's histogram.

    ``first`` names a column that orders the rows; without it ``seen`` is zero throughout.
    """

    def of_book(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        seen = pdf["seen"].rank(method="dense").to_numpy(float)
        cuts, peaks, raw = function(pdf["value"].to_numpy(float), pdf["count"].to_numpy(float), seen)
        return pd.DataFrame({"book_id": [pdf["book_id"].iloc[0]], "cuts": [cuts], "peaks": [peaks], "raw_tiers": [raw]})

    place = F.min(first).cast("string") if first else F.lit("")
    histogram = values.groupBy("book_id", "value").agg(F.count("*").alias("count"), place.alias("seen"))
    # the work of a book does not follow from the size of its histogram, by which small partitions would be put together
    spread = histogram.repartition(2 * values.sparkSession.sparkContext.defaultParallelism, "book_id")
    return spread.groupBy("book_id").applyInPandas(of_book, "book_id string, cuts array<double>, peaks array<double>, raw_tiers int")


def font_cuts(lines: DataFrame) -> DataFrame:
    """Cuts between the font sizes of each book (robust valleys, nothing merged)."""

    def f(v, c, _):
        cuts = robust_valleys(v, c)
        return cuts, [], len(cuts) + 1

    return _of_books(lines.select("book_id", F.round("font_size", 2).alias("value")).where("value is not null"), f)


def height_cuts(lines: DataFrame, min_tier_count: int = 5) -> DataFrame:
    """Cuts (to four places) and peaks of the positive line heights of each book, sparse tiers merged; ``lines`` in order of page, y0, x0, line_id."""

    def f(v, c, seen):
        cuts, peaks = peak_cuts(v, c)
        raw = len(peaks)
        cuts, peaks = merge_sparse(v, c, seen, cuts, peaks, min_tier_count)
        return [round(x, 4) for x in cuts], peaks, raw

    # a text that sorts as the place does
    place = F.format_string("%09d %016.4f %016.4f %020d", F.col("pdf_page").cast("int"), F.col("y0") + 1e6, F.col("x0") + 1e6, F.col("line_id").cast("long"))
    return _of_books(lines.where("height > 0").select("book_id", F.round("height", 2).alias("value"), place.alias("place")), f, "place")


def tier_sets(lines: DataFrame, cuts: DataFrame, column: str) -> DataFrame:
    """(book_id, tier, lower_bound, upper_bound, peak, count) of every class between a book's cuts, empty ones as well.

    The peak is the one of ``cuts`` (book_id, cuts, peaks) inside the class that is nearest to the median of its lines, of equals the larger;
    without one it is that median, and of an empty class a bound. The largest class has no upper bound, the smallest no lower one.
    """
    falling = F.reverse(F.array_sort("cuts"))
    classes = cuts.select("book_id", falling.alias("c"), "peaks").select("book_id", "c", "peaks", F.explode(F.sequence(F.lit(1), F.size("c") + 1)).alias("tier"))
    bounds = classes.withColumn("lower_bound", F.get("c", F.col("tier") - 1)).withColumn("upper_bound", F.when(F.col("tier") > 1, F.get("c", F.col("tier") - 2)))
    own = F.filter("peaks", lambda p: (F.col("lower_bound").isNull() | (p >= F.col("lower_bound"))) & (F.col("upper_bound").isNull() | (p < F.col("upper_bound"))))
    held = with_tier(lines.where(F.col(column) > 0), cuts, column).groupBy("book_id", "tier").agg(F.count("*").alias("count"), F.percentile(column, F.lit(0.5)).alias("middle"))
    full = bounds.withColumn("own", own).join(held, ["book_id", "tier"], "left")
    middle = F.coalesce("middle", F.get(F.array_sort("own"), F.floor((F.size("own") - 1) / 2).cast("int")))
    nearest = F.array_min(F.transform("own", lambda p: F.struct(F.abs(p - middle).alias("d"), (-p).alias("m"))))
    peak = F.when(F.size("own") > 0, -nearest["m"]).otherwise(F.coalesce("middle", "lower_bound", "upper_bound", F.lit(0.0)))
    return full.select("book_id", "tier", "lower_bound", "upper_bound", F.round(peak, 4).alias("peak"), F.coalesce("count", F.lit(0)).alias("count"))


def gap_limit(gaps: DataFrame) -> DataFrame:
    """(book_id, body_spacing, continuation_upper) from the gaps between body lines (book_id, value).

    The spacing is the median gap; lines go on up to the first valley at or above it among the
    gaps below Q3 + 1.5 IQR, or up to the largest of those.
    """

    def f(v, c, _):
        middle = _quantile(v, c, 0.5)
        q1, q3 = _quantile(v, c, 0.25), _quantile(v, c, 0.75)
        core = v <= q3 + 1.5 * (q3 - q1)
        above = [x for x in robust_valleys(v[core], c[core], points=1024, fallback=False) if x >= middle]
        return [middle, above[0] if above else float(v[core].max())], [], 0

    return _of_books(gaps, f).select("book_id", F.col("cuts")[0].alias("body_spacing"), F.col("cuts")[1].alias("continuation_upper"))


def tier_of(value: Column, cuts: Column) -> Column:
    """1 for the largest values: one more than the cuts above the value."""
    return F.size(F.filter(cuts, lambda c: c > value)) + 1


def with_tier(rows: DataFrame, cuts: DataFrame, column: str, name: str = "tier") -> DataFrame:
    """``rows`` with the tier of ``column``; books without cuts have tier 1."""
    joined = rows.join(cuts.select("book_id", F.col("cuts").alias("__cuts")), "book_id", "left")
    return joined.withColumn(name, tier_of(F.col(column), F.coalesce("__cuts", F.array().cast("array<double>")))).drop("__cuts")


def tier_summary(lines: DataFrame) -> DataFrame:
    """(book_id, tier, lines, median_size, text_length) of lines with a ``tier``."""
    return lines.groupBy("book_id", "tier").agg(F.count("*").alias("lines"), F.percentile("font_size", F.lit(0.5)).alias("median_size"), F.coalesce(F.sum(text_length("text")), F.lit(0)).alias("text_length"))


def tier_coverage(lines: DataFrame, coverage: float = 0.95) -> DataFrame:
    """The summary with ``body``: the tiers with most text that together reach ``coverage``, the one that crosses it included."""
    by = Window.partitionBy("book_id").orderBy(F.desc("text_length"), F.desc("lines"), "tier")
    whole = F.sum("text_length").over(Window.partitionBy("book_id"))
    before = F.coalesce(F.sum("text_length").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(by) == 1
    return tier_summary(lines).withColumn("body", F.when(whole == 0, first).otherwise(before / whole < coverage))


def font_profile(lines: DataFrame, coverage: float = 0.95) -> DataFrame:
    """(book_id, body_tiers, candidate_tiers, body_size, body_ratio): size that stands for the body is the median of its lines."""
    tiers = tier_coverage(lines, coverage)
    sets = tiers.groupBy("book_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("body"), F.col("tier")))).alias("body_tiers"),
        F.array_sort(F.collect_set(F.when(~F.col("body"), F.col("tier")))).alias("candidate_tiers"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("body"), F.col("text_length")).otherwise(0)), F.sum("text_length")), F.lit(0.0)).alias("body_ratio"),
    )
    body = lines.join(tiers.where("body").select("book_id", "tier"), ["book_id", "tier"], "left_semi")
    return sets.join(body.groupBy("book_id").agg(F.percentile("font_size", F.lit(0.5)).alias("body_size")), "book_id")


def body_gaps(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """(book_id, pdf_page, value): positive y0 gaps of neighbouring body lines that overlap in width."""
    body = lines.join(profile.select("book_id", "body_tiers"), "book_id").where(F.array_contains("body_tiers", F.col("tier")))
    by = Window.partitionBy("book_id", "pdf_page").orderBy("y0", "x0", "line_id")
    prev = body.select("book_id", "pdf_page", "y0", "x0", "x1", F.lag("y0").over(by).alias("py0"), F.lag("x0").over(by).alias("px0"), F.lag("x1").over(by).alias("px1"))
    wide = F.greatest("x0", "px0") < F.least("x1", "px1")
    return prev.where((F.col("y0") > F.col("py0")) & wide).select("book_id", "pdf_page", F.round(F.col("y0") - F.col("py0"), 2).alias("value"))
