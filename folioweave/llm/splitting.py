"""Cutting oversized texts at natural boundaries by pointer doubling.

Every legal boundary of a text points to the farthest one that a piece starting there may reach.
Squaring this table of successors gives the boundaries 2^k pieces ahead, so all cuts of all texts
are found in as many joins as the longest text's number of pieces has bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.tokenize import WHITE
from folioweave.runtime import cut, rounds_for

#: Words with the white space after them; leading white space of a text belongs to no word.
TOKEN = rf"[^{WHITE}]++[{WHITE}]*+"


def words_of(text: Column | str) -> Column:
    """Words, each with the white space that follows it."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _rank(this: Column, following: Column) -> Column:
    """How good a cut after the word ``this`` is: 3 block, 2 line of a list or table, 1 sentence, 0 none."""
    return (
        F.when(this.rlike(r"\n[^\S\n]*\n") | (this.contains("\n") & following.rlike(r"^#{1,6}\s")), 3)
        .when(this.contains("\n") & following.rlike(r"^(?:[-*+•|>]|\d+[.)])"), 2)
        .when(this.rlike(r"[.!?…。][\"'”’»)\]]*\s+$"), 1)
        .otherwise(0)
    )


def boundaries(docs: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, max_words, overlap, pos, rank) of the legal boundaries of each oversized text.

    A boundary is named by the number of words before it. Natural ones are as :func:`_rank`
    says; inside a fenced block of code there are none. Where two of them are farther apart than a
    quarter of what a piece may add, word boundaries at that spacing stand in, so that a successor always exists.
    Within the first ``overlap`` words no cut is legal: the piece after it would begin before the text does.
    """
    step = F.greatest(F.lit(1), F.floor((F.col("max_words") - F.col("overlap")) / 4)).cast("int")
    marked = docs.withColumn("marks", F.zip_with("words", F.concat(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(1))), F.array(F.lit(""))), lambda a, b: _rank(a, F.coalesce(b, F.lit("")))))
    fences = F.filter(F.transform("words", lambda w, i: F.when(w.startswith("```") | w.startswith("~~~"), i)), lambda i: i.isNotNull())
    marked = marked.withColumn("fences", fences)
    outside = lambda pos: F.size(F.filter("fences", lambda f: f < pos)) % 2 == 0
    natural = F.filter(F.transform("marks", lambda r, i: F.struct((i + 1).alias("pos"), r.alias("rank"))), lambda x: (x["rank"] > 0) & (x["pos"] < F.col("n")))
    natural = F.when(F.size("fences") > 0, F.filter(natural, lambda x: outside(x["pos"]))).otherwise(natural)
    start, end = F.struct(F.lit(0).alias("pos"), F.lit(3).alias("rank")), F.struct(F.col("n").alias("pos"), F.lit(3).alias("rank"))
    wide = marked.withColumn("marks", F.concat(F.array(start), natural, F.array(end))).withColumn("step", step)
    filled = F.flatten(
        F.transform(
            "marks",
            lambda x, i: F.when(
                (i > 0) & (x["pos"] - F.get("marks", i - 1)["pos"] > F.col("step")),
                F.concat(
                    F.transform(F.sequence(F.get("marks", i - 1)["pos"] + F.col("step"), F.greatest(x["pos"] - 1, F.get("marks", i - 1)["pos"] + F.col("step")), F.col("step")), lambda p: F.struct(p.alias("pos"), F.lit(0).alias("rank"))),
                    F.array(x),
                ),
            ).otherwise(F.array(x)),
        )
    )
    return wide.select(*key, "n", "max_words", "overlap", F.explode(filled).alias("b")).select(*key, "n", "max_words", "overlap", "b.pos", "b.rank").where("pos = 0 or pos > overlap")


def successors(bounds: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos, next): the farthest legal successor of each boundary.

    A piece from boundary b begins ``overlap`` words earlier (except at 0), so it may reach
    b + max_words - overlap. The farthest natural boundary there is its successor, the end of the text first of all; a word
    boundary is legal only where no natural one is within reach. Joined on (key, block of positions),
    blocks being as wide as a piece: a boundary meets only the boundaries within its reach.
    """
    b = bounds.withColumn("reach", F.col("max_words") - F.when(F.col("pos") > 0, F.col("overlap")).otherwise(0))
    left = b.where("pos < n").select(*key, "pos", "reach", F.col("max_words").alias("w"), F.explode(F.array(F.floor(F.col("pos") / F.col("max_words")), F.floor(F.col("pos") / F.col("max_words")) + 1)).alias("blk"))
    right = b.where("pos > 0").select(*key, F.col("pos").alias("to"), "rank", F.floor(F.col("pos") / F.col("max_words")).alias("blk"), F.col("n"))
    pairs = left.join(right, [*key, "blk"]).where((F.col("to") > F.col("pos")) & (F.col("to") <= F.col("pos") + F.col("reach")))
    order = F.struct((F.col("rank") > 0).alias("natural"), F.col("to").alias("to"))
    return pairs.groupBy(*key, "pos").agg(F.max_by("to", order).alias("next"))


def cuts(succ: DataFrame, key: list[str], pieces: int) -> DataFrame:
    """(key, pos): the boundaries on every text's way from 0, its end included."""
    jump = cut(succ)
    reached = jump.where("pos = 0").select(*key, "pos")
    for k in range(rounds_for(pieces)):
        step = reached.join(jump, [*key, "pos"]).select(*key, F.col("next").alias("pos"))
        reached = cut(reached.unionByName(step).distinct())
        if k + 1 < rounds_for(pieces):
            jump = cut(jump.join(jump.select(*key, F.col("pos").alias("next"), F.col("next").alias("far")), [*key, "next"]).select(*key, "pos", F.col("far").alias("next")))
    return reached


def split(docs: DataFrame, key: list[str], text: str, max_words: str, overlap: str) -> DataFrame:
    """(key, piece, n_pieces, start_word, n_words, content) of every text over its limit.

    Words are set apart by any Unicode white space. Consecutive pieces share exactly ``overlap``
    words (fewer where the limit leaves no room: an overlap is cut to half the limit; below 0 it
    counts as 0). Texts within their limit, null or empty texts and rows with a null key or limit,
    or a limit under 1, give no pieces. Rows repeated under one key count once. The pieces without their
    overlap, put together, are the text less its leading white space.
    """
    limit = F.col(max_words).cast("int")
    there = docs.where(F.col(text).isNotNull() & (limit >= 1)).select(
        *key, F.col(text).alias("__text"), limit.alias("max_words"), F.least(F.greatest(F.coalesce(F.col(overlap).cast("int"), F.lit(0)), F.lit(0)), F.floor(limit / 2).cast("int")).alias("overlap")
    )
    # a text of n words has at least 2n - 1 characters, so most texts are not even read into words
    over = there.where(F.length("__text") >= 2 * F.col("max_words") + 1).dropDuplicates(key)
    over = over.withColumn("words", words_of("__text")).drop("__text").withColumn("n", F.size("words")).where("n > max_words")
    over = cut(over)
    bounds = boundaries(over, key)
    # two pieces in a row always pass what one may add, else the first would have reached farther; so their number is bounded
    longest = over.agg(F.max(F.ceil(4 * F.col("n") / F.greatest(F.lit(1), F.col("max_words") - F.col("overlap"))) + 2)).first()[0]
    places = cuts(successors(cut(bounds), key), key, longest or 1)
    ends = places.groupBy(*key).agg(F.array_sort(F.collect_list("pos")).alias("ends"))
    piece = F.transform(
        F.sequence(F.lit(1), F.size("ends") - 1),
        lambda i: F.struct(
            i.alias("piece"),
            F.when(i == 1, F.lit(0)).otherwise(F.get("ends", i - 1) - F.col("overlap")).alias("start_word"),
            F.get("ends", i).alias("end"),
        ),
    )
    return (
        over.join(ends, key)
        .withColumn("p", F.explode(piece))
        .select(
            *key,
            F.col("p.piece").alias("piece"),
            (F.size("ends") - 1).alias("n_pieces"),
            F.col("p.start_word").alias("start_word"),
            (F.col("p.end") - F.col("p.start_word")).alias("n_words"),
            F.array_join(F.slice("words", F.col("p.start_word") + 1, F.col("p.end") - F.col("p.start_word")), "").alias("content"),
        )
    )
