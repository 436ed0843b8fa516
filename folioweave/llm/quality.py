"""Per-document text statistics and fixed-threshold rules that tell prose from lists, tables and junk.

All statistics are built-in expressions over the row, so nothing is shuffled and no text leaves
the JVM. Null, empty and blank texts have null statistics, no reasons and kind ``blank``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.tokenize import WHITE

# Published rules for web corpora. Rae et al. 2021 (Gopher): mean word length from 3 to 10, marks (# and ellipses) up to a
# tenth of the words, bullets on up to 0.9 and ellipses on up to 0.3 of the lines, two stop words at least.
# Penedo et al. 2024 (FineWeb): over 0.12 of the lines end in punctuation, under 0.67 of them are short. Gopher's bounds on a document's
# number of words are left out, as these documents are pages.
WORD_LENGTH = (3.0, 10.0)
MAX_MARK_RATIO = 0.1
MAX_BULLET_LINES = 0.9
MAX_ELLIPSIS_LINES = 0.3
MIN_STOP_WORDS = 2
MIN_PUNCTUATED_LINES = 0.12
MAX_SHORT_LINES = 0.67
# Thresholds of this project: they tell what kind of document it is that a published rule fails.
MAX_WORD_LENGTH = 9.0
MAX_SYMBOL_SHARE = 0.40
MIN_COMMON_SHARE = 0.03
#: Lines of fewer characters are short.
SHORT_LINE = 30
TABLE_SHARE = 0.5
LIST_SHARE = 0.5
MAX_ODD_PUNCTUATION = 0.3
MAX_MIXED_WORDS = 0.15
MAX_PHRASE = 80

_CELL = r"(?:[(\[]?[-–+]?\d[\d.,]*%?[)\]]?|n/a|-|–)"
_GAP = r"(?: {2}|\t)[ \t]*+"
#: A row of cells: pipes, table markup, separated values, or columns set apart by white space.
TABLE_LINE = (
    r"^\||</?t[rdh]\b|\|.*\||"
    r"^(?=.*(?:\d|n/a))[^,;]{0,80}?(?:[;,](?:\(?-?\d[\d.]*%?\)?|n/a|-|(?=[;,]|$)))+$|"
    rf"{_GAP}{_CELL}{_GAP}{_CELL}(?:\s|$)|"
    r"^[\d\s.,%()\-–/]*\d[\d\s.,%()\-–/]*$|"
    rf"{_GAP}(?:\(\d[\d.]*\)|\d+\.\d+%?|\d+%|n/a|-)$"
)
#: An entry: bullet, heading mark or number at its start, or a page reference at its end.
BULLET_LINE = r"^\s*(?:[-–—•*▪◦‣·+>]\s+|#{1,6}\s|(?:\d{1,3}|[ivxlcIVXLC]{1,5}|[A-Za-z])[.):]\s|\d+(?:\.\d+)+\.?\s)"
PAGE_LINE = r"(?:[.•·…]|\s)\s*\d{1,4}$|, \d{1,4}$"
END_LINE = r"[.!?…。:;][\s\"”’»)\]]*$"
INNER_END = r"[.!?…。][\"”’»)\]]*\s+\S"
#: Lines of a node's front matter say nothing of its text.
FRONT_LINE = r"^(?:---+|[a-z_]+: \S+)$"
ODD_PUNCTUATION = r"(?<=[\p{L}\p{N}])[.,;:?!]++(?=\p{L})|(?<=\s)[.,](?=[\p{L}\s])"
MIXED_WORD = r"\p{L}\p{N}+\p{L}|\p{Ll}\p{Lu}|\p{N}\p{L}+\p{N}"


def common_word_table(words: DataFrame, word: str) -> tuple[list[str], int, int]:
    """The fixed list of common words as a hash table under Spark's own hash.

    Of 8 to 256 places a word, the fewest that part all words are taken. If none do, words whose place is taken go on to the next
    free one and ``probes`` tells how far; so the table's size follows the list.
    """
    rows = words.where(F.length(word) > 1).select(word, F.hash(word)).distinct().orderBy(word).collect()
    size = 1 << max(8, (8 * len(rows)).bit_length())
    for _ in range(5):
        if len({h & (size - 1) for _, h in rows}) < len({h for _, h in rows}):
            size *= 2
    table, probes = [""] * size, 1
    for w, h in rows:
        n = 0
        while table[(h + n) & (size - 1)]:
            n += 1
        table[(h + n) & (size - 1)], probes = w, max(probes, n + 1)
    return table, size - 1, probes


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _total(lines: Column, of) -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, x: n + of(x))


def statistics(docs: DataFrame, key: str, text: str, common_words: tuple[list[str], int, int]) -> DataFrame:
    """(key, n_words, mean_word_length, symbol_ratio, punct_line_share, bullet_line_share, common_share, n_common,
    mark_ratio, ellipsis_line_share, short_line_share, table_share, list_share, odd_share, mixed_share, repeats), one row a document.

    ``odd_share`` and ``mixed_share`` are of running text only: null for tables and lists.

    ``common_words`` is a table of :func:`common_word_table`; words of one letter don't count as common, for
    shuffled letters are full of them. Words are set apart by white space; shares of tables and
    lists are by characters.
    """
    t = F.col("__t")
    there = t.isNotNull() & t.rlike(rf"[^{WHITE}]")
    base = docs.select(key, F.col(text).alias("__t")).select(key, F.when(there, t).alias("__t"))
    plain = t
    for blank in ("\n", "\t", "\r", "\xa0", "　"):
        plain = F.replace(plain, F.lit(blank), F.lit(" "))

    def line(l: Column) -> Column:
        """Kind and sizes of one line; what most lines lack is looked for before any pattern is tried."""

        def sized(x: Column) -> Column:
            s = x["s"]
            cells = s.contains("|") | s.contains("  ") | s.contains("\t") | s.contains("<") | s.contains(";") | x["digit"] | s.endswith("-") | s.endswith("n/a") | s.endswith("%") | s.endswith(")")
            kind = (
                F.when((x["n"] < 40) & s.rlike(FRONT_LINE), "f")
                .when(cells & s.rlike(TABLE_LINE), "t")
                .when((x["b"] | (x["digit"] & s.rlike(PAGE_LINE))) & ~(x["end"] & (x["n"] >= 50)), "l")
                .when(x["end"], "p")
                .otherwise("u")
            )
            one = F.lit(1)
            return F.transform(
                F.array(kind),
                lambda k: F.struct(
                    k.alias("k"), x["n"].alias("n"), F.when(k == "u", F.regexp_count(s, F.lit(INNER_END))).otherwise(0).alias("e"),
                    F.when(x["end"], one).otherwise(0).alias("p"), F.when(x["b"], one).otherwise(0).alias("b"),
                    F.when(s.endswith("...") | s.endswith("…"), one).otherwise(0).alias("y"), F.when(x["n"] < SHORT_LINE, one).otherwise(0).alias("q"),
                ),
            )[0]

        s = F.rtrim(l)
        last = F.substring(s, -1, 1)
        facts = F.struct(s.alias("s"), F.length(s).alias("n"), F.substring(s, -4, 4).rlike(END_LINE).alias("end"), last.between("0", "9").alias("digit"), s.rlike(BULLET_LINE).alias("b"))
        return F.transform(F.array(facts), sized)[0]

    lines = F.transform(F.filter(F.split(t, "\n"), lambda l: F.trim(l) != ""), line)
    table, mask, probes = common_words
    literal = F.from_json(F.lit(json.dumps(table)), "array<string>")

    def is_common(w: Column) -> Column:
        hit = F.get(literal, F.hash(w).bitwiseAND(F.lit(mask))) == w
        for n in range(1, probes):
            hit = hit | (F.get(literal, (F.hash(w) + n).bitwiseAND(F.lit(mask))) == w)
        return hit

    common = F.size(F.filter(F.array_remove(F.split(F.lower(F.col("plain")), " "), ""), is_common))
    counts = ("all", "t", "l", "u", "nu", "e", "p", "b", "np", "y", "q")
    wide = base.withColumn("plain", plain).withColumn("lines", lines)
    sums = wide.select(
        key,
        "__t",
        F.array_remove(F.split("plain", " "), "").alias("words"),
        F.length(F.replace("plain", F.lit(" "), F.lit(""))).alias("chars"),
        F.regexp_count(t, F.lit(rf"[^{WHITE}\p{{L}}\p{{N}}\p{{M}}]")).alias("symbols"),
        common.alias("common"),
        # most texts have none of the marks, which is quickly seen
        F.when(
            F.col("plain").contains("#") | F.col("plain").contains("...") | F.col("plain").contains("…"),
            F.length("plain") - F.length(F.replace(F.replace(F.replace("plain", F.lit("#"), F.lit("")), F.lit("..."), F.lit("..")), F.lit("…"), F.lit(""))),
        ).otherwise(0).alias("marks"),
        F.size("lines").alias("n_lines"),
        F.aggregate(
            "lines",
            F.struct(*[F.lit(0).alias(c) for c in counts]),
            lambda a, i: F.struct(
                (a["all"] + F.when(i["k"] == "f", 0).otherwise(i["n"])).alias("all"),
                (a["t"] + F.when(i["k"] == "t", i["n"]).otherwise(0)).alias("t"),
                (a["l"] + F.when(i["k"] == "l", i["n"]).otherwise(0)).alias("l"),
                (a["u"] + F.when(i["k"] == "u", i["n"]).otherwise(0)).alias("u"),
                (a["nu"] + F.when(i["k"] == "u", 1).otherwise(0)).alias("nu"),
                (a["e"] + i["e"]).alias("e"),
                (a["p"] + i["p"]).alias("p"),
                (a["b"] + i["b"]).alias("b"),
                (a["np"] + F.when(i["k"] == "p", 1).otherwise(0)).alias("np"),
                (a["y"] + i["y"]).alias("y"),
                (a["q"] + i["q"]).alias("q"),
            ),
        ).alias("s"),
    )
    s = F.col("s")
    # unmarked lines are entries when they are short, or when no sentence ever ends inside them
    bare = (s["nu"] > 0) & (
        (s["u"] <= 24 * s["nu"]) | ((s["nu"] >= 5) & (s["e"] < 0.08 * s["nu"])) | ((s["np"] == 0) & (s["e"] == 0) & (s["nu"] >= 2))
    )

    # a phrase said again and again: few words, and nearly every one has one successor only
    few = (F.col("n_words") >= 8) & (F.col("n_distinct") <= MAX_PHRASE) & (F.col("n_words") >= 3 * F.col("n_distinct"))
    successors = F.size(F.array_distinct(F.zip_with(F.slice("words", F.lit(1), F.col("n_words") - 1), F.slice("words", F.lit(2), F.col("n_words") - 1), lambda a, b: F.concat_ws(" ", a, b))))
    repeats = F.when(few & (F.col("bullet_line_share") < 0.5), successors <= 1.5 * F.col("n_distinct") + 1).otherwise(False)

    shares = sums.select(
        key,
        "__t",
        "words",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        _share(F.col("chars"), F.size("words")).alias("mean_word_length"),
        _share(F.col("symbols"), F.col("chars")).alias("symbol_ratio"),
        _share(s["p"], F.col("n_lines")).alias("punct_line_share"),
        _share(s["b"], F.col("n_lines")).alias("bullet_line_share"),
        _share(F.col("common"), F.size("words")).alias("common_share"),
        F.col("common").alias("n_common"),
        _share(F.col("marks"), F.size("words")).alias("mark_ratio"),
        _share(s["y"], F.col("n_lines")).alias("ellipsis_line_share"),
        _share(s["q"], F.col("n_lines")).alias("short_line_share"),
        _share(s["t"], s["all"]).alias("table_share"),
        _share(s["l"] + F.when(bare, s["u"]).otherwise(0), s["all"]).alias("list_share"),
    )
    running = (F.col("table_share") < TABLE_SHARE) & (F.col("list_share") < LIST_SHARE)
    odd = _share(F.regexp_count(t, F.lit(ODD_PUNCTUATION)), F.regexp_count(t, F.lit("[.,;:?!]")))
    mixed = _share(F.regexp_count(t, F.lit(MIXED_WORD)), F.col("n_words"))
    filled = t.isNotNull()
    return shares.select(
        key,
        *[F.when(filled, F.col(c)).alias(c) for c in ("n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "bullet_line_share", "common_share", "n_common", "mark_ratio", "ellipsis_line_share", "short_line_share", "table_share", "list_share")],
        F.when(running & filled, odd).alias("odd_share"),
        F.when(running & filled, mixed).alias("mixed_share"),
        F.when(filled, repeats).otherwise(False).alias("repeats"),
        # Korean function words are endings, which no list of words can hold
        F.when(running & (F.col("common_share") < MIN_COMMON_SHARE), t.rlike(r"\p{IsHangul}")).otherwise(False).alias("hangul"),
        filled.alias("filled"),
    )


def classify(stats: DataFrame, key: str) -> DataFrame:
    """``stats`` with ``failed`` (the published rules that fail, in their order), ``reasons`` (what speaks for a kind) and ``kind``.

    Kind is ``prose``, ``list``, ``table``, ``junk`` or ``blank``. A document is prose unless a published rule fails; then the
    reasons tell its kind, and without any it is prose that fails a rule. Junk wins over list, except
    that a table's symbols and figures are no junk.
    """
    c = F.col
    published = [
        (~c("mean_word_length").between(*WORD_LENGTH), "gopher_word_length"),
        (c("mark_ratio") > MAX_MARK_RATIO, "gopher_symbol_ratio"),
        (c("bullet_line_share") > MAX_BULLET_LINES, "gopher_bullet_lines"),
        (c("ellipsis_line_share") > MAX_ELLIPSIS_LINES, "gopher_ellipsis_lines"),
        (c("n_common") < MIN_STOP_WORDS, "gopher_stop_words"),
        (c("punct_line_share") <= MIN_PUNCTUATED_LINES, "fineweb_line_punctuation"),
        (c("short_line_share") >= MAX_SHORT_LINES, "fineweb_short_lines"),
    ]
    table = c("table_share") >= TABLE_SHARE
    listed = c("list_share") >= LIST_SHARE
    kinds = [
        (table, "table_rows"),
        ((c("symbol_ratio") > MAX_SYMBOL_SHARE) & ~table, "symbols"),
        ((c("mean_word_length") > MAX_WORD_LENGTH) & ~table, "word_length"),
        (c("repeats") & ~table, "repetition"),
        ((c("odd_share") >= MAX_ODD_PUNCTUATION) & ~table & ~listed, "scattered_punctuation"),
        ((c("mixed_share") > MAX_MIXED_WORDS) & ~table & ~listed, "mixed_words"),
        ((c("common_share") < MIN_COMMON_SHARE) & (c("n_words") >= 15) & ~c("hangul") & ~table & ~listed, "no_common_words"),
        (listed & ~table, "entries"),
    ]
    told = lambda rules: F.array_compact(F.array(*[F.when(r & c("filled"), F.lit(n)) for r, n in rules]))
    first = F.get("reasons", F.lit(0))
    kind = (
        F.when(~c("filled"), "blank")
        .when((F.size("failed") == 0) | (F.size("reasons") == 0), "prose")
        .when(first == "table_rows", "table")
        .when(first == "entries", "list")
        .otherwise("junk")
    )
    return stats.withColumn("failed", told(published)).withColumn("reasons", told(kinds)).withColumn("kind", kind).drop("hangul", "filled")
