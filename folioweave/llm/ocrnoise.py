"""Noise of scanned pages: running headers, page numbers, cut words, misread characters.

Misread words are decoded by a noisy channel: candidates come from inverting character
confusions and looking the result up in the corpus's own words, and each line is decoded by
Viterbi over its candidates with the corpus's bigram counts. Counts cover all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.linkage import STROKES
from folioweave.runtime import cut, cut_table

# What is seen, and what it may have been before it was misread.
CONFUSIONS = (
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("c", "e"), ("b", "h"), ("f", "t"), ("q", "g"), ("h", "li"), ("m", "in"),
    ("5", "s"), ("0", "o"), ("1", "l"), ("1", "i"), ("8", "b"), ("@", "a"), ("6", "b"), ("6", "g"), ("9", "g"), ("2", "z"), ("l", "i"), ("i", "l"), ("o", "a"), ("tl", "d"), ("ni", "m"), ("|", "l"), ("!", "l"),
    ("|", "i"), ("!", "i"), ("m", "rn"),
)
#: Parts of a page's height that hold nothing but headers and page numbers.
TOP, FOOT = 0.065, 0.93
#: Probability of a confusion before the corpus is asked, and how many of its chances that counts for.
FIRST_GUESS, GUESS_WEIGHT = 0.004, 1000.0
#: Rounds of estimating the confusions' probabilities from the corpus.
EM_ROUNDS = 2
#: A word that is seen nowhere else counts for so many times the rate at which characters are misread.
OWN_FLOOR = 5.0
#: Share of a word's probability that comes from the word before it, the rest being its own frequency.
BIGRAM_SHARE = 0.7
#: What the same confusion weighs when a word has it again.
AGAIN = 0.25
#: Share of a word's occurrences that may be misread in the same way, where a misreading recurs.
RECURS = 0.04
#: Digits and signs that stand for letters.
SIGNS = frozenset(c for seen, _ in CONFUSIONS for c in seen if not c.isalpha())

HYPHENS = "-‐\xad¬"
TOKEN = r"(?:[|!](?=\p{L}))?+[\p{L}\p{M}\p{N}@]++(?:[|!]++[\p{L}\p{M}\p{N}@]++)*+"
DIGITS_SEEN = r"[0-9lIOoZSBgbqi|!]"
NUMBER_ROW = rf"^[\s\-–—•|·\[(]*(?:(?i:page|p\.|seite|s\.|стр\.|с\.|pág\.|página|쪽)\s*)?(?:{DIGITS_SEEN}{{1,4}}|[0-9lIOoZSBgbq](?:\s[0-9lIOoZSBgbq]){{1,3}}|[ivxlcdmIVXLCDM]{{1,8}})(?:\s*/\s*{DIGITS_SEEN}{{1,4}})?[\s\-–—•|·\])./]*$"
#: What a contents list is headed by, letters set apart or not.
CONTENTS = r"^(?i)(?:contents|table of contents|inhalt|inhaltsverzeichnis|índice|indice|sumário|sommaire|table des matières|оглавление|содержание|목차|차례)(?:\s+[0-9ivxlcdm]+)?$"
#: The place of a page number in a contents line: after a leader, before a separator or the end.
ENTRY_PAGE = rf"(?:\.\s?){{3,}}\s*({DIGITS_SEEN}{{1,4}})(?=\s*(?:$|[|/I]\s|\s{{2}}))|•\s*({DIGITS_SEEN}{{1,4}})(?=\s*(?:$|[|/I]\s|\s{{2}}))|\S\s{{2,}}({DIGITS_SEEN}{{1,4}})(?=$|\s*[|/I]\s|\s{{2}})"


#: The tables, named by their place while rows are worked on.
SOURCES = ("visual_rows", "ocr_line_stats", "subsection_report")
REPORT = SOURCES.index("subsection_report")


def _named(df: DataFrame) -> DataFrame:
    """``df`` with its tables' names."""
    return df.withColumn("source_table", F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.col("source_table") + 1))


def rows_of(visual: DataFrame, ocr: DataFrame, report: DataFrame) -> DataFrame:
    """The three tables as (source_table: its place in SOURCES, row_id, flow, page, seq, height, text, counted), once for each key.

    ``flow`` is what is read in one go: a book, or a report's contents list. ``height`` is the
    place on the page from 0 to 1, null where it is not known and for contents lines. ``counted``
    is false for rows whose line another row of the report already stands for: the corpus's words
    are counted once for each line.
    """
    none = F.lit(None).cast("double")
    v = visual.select(F.lit(0).cast("byte").alias("source_table"), F.col("row_id").cast("long").alias("row_id"), F.col("book_id").alias("flow"), F.col("pdf_page").alias("page"), F.col("row_seq").cast("long").alias("seq"), F.try_divide("y0", "page_height").alias("height"), "text")
    o = ocr.select(F.lit(1).cast("byte").alias("source_table"), F.col("stat_id").cast("long").alias("row_id"), F.col("book_id").alias("flow"), F.col("pdf_page").alias("page"), F.col("stat_id").cast("long").alias("seq"), F.col("y_center_ratio").alias("height"), "text")
    r = report.select(F.lit(2).cast("byte").alias("source_table"), F.col("sub_id").cast("long").alias("row_id"), F.col("report_id").alias("flow"), F.col("chapter").alias("page"), F.col("sub_id").cast("long").alias("seq"), none.alias("height"), F.col("raw_line").alias("text"))
    # grouped, not windowed, so that a line that very many rows share is no single task
    lines = r.groupBy("flow", "text").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("first"))
    r = r.join(lines, "row_id", "left").withColumn("counted", F.coalesce("first", F.lit(False))).drop("first")
    books = v.unionByName(o).withColumn("counted", F.lit(True))
    # rows repeated under one key agree in all columns that are read, and whole rows are made distinct by hash, without a sort
    return books.unionByName(r).distinct()


#: A header that no other page repeats has at most so many words.
HEADER_WORDS = 8


def _header_key(text: Column) -> Column:
    """What repeats of a header have in common: its longest part between bars and wide gaps, without page number, case,
    blanks and signs, in characters that a misreading doesn't change."""
    parts = F.array_sort(F.transform(F.split(F.lower(text), r"\s{2,}|\|"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    plain = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1)["x"], r"^\s*(?:\d{1,4}\s+){1,4}|(?:\s\d{1,4}){1,4}\s*$", ""), r"[^\p{L}\p{N}|!@]+", "")
    one = {k: v for k, v in STROKES.items() if len(v) == 1}
    key = F.translate(plain, "".join(one), "".join(one.values()))
    for k, v in STROKES.items():
        if len(v) > 1:
            key = F.replace(key, F.lit(k), F.lit(v))
    return key


def margins(rows: DataFrame) -> DataFrame:
    """Rows that aren't blank, with ``margin``: ``running_header``, ``page_number`` or null.

    In the top or foot band what reads like a number is one, and what another page of the flow has there as well,
    or what has a title's shape (HEADER_WORDS words at most, the first with a capital, no sentence's end), is a header. A row of unknown height is,
    if it is the first or last of its page and reads like a number, or like a header of the same flow.
    Contents lines are, if they are a contents title or nothing but a number.
    """
    t = F.trim("text")
    contents = F.col("source_table") == REPORT
    band = (F.col("height") <= TOP) | (F.col("height") >= FOOT)
    lost = ~contents & F.col("height").isNull()
    spaced = F.regexp_replace(t, r"(?<=\p{L})\s(?=\p{L}(?:\s|$))", "")
    kind = F.when(t.rlike(NUMBER_ROW), "page_number").when(contents, F.when(t.rlike(CONTENTS) | spaced.rlike(CONTENTS), "running_header")).when(band, "running_header")
    # the forms are looked at once, where a row may be a margin at all; every later pass only reads what was found
    unsure = F.when(lost, 1).when(~contents & band & (F.col("margin") == "running_header"), 2).otherwise(0)
    base = cut_table(rows.where(F.length(t) > 0).withColumn("margin", F.when(contents | band | lost, kind)).withColumn("unsure", F.coalesce(unsure, F.lit(0))).drop("height"))
    flow = ["source_table", "flow"]
    in_band = base.where("unsure = 2").withColumn("key", _header_key(t))
    keys = in_band.groupBy(*flow, "key").agg((F.min("page") < F.max("page")).alias("again"))
    shaped = (F.regexp_count(t, F.lit(r"\p{L}{2,}")) <= HEADER_WORDS) & t.rlike(r"^[^\p{L}]*[\p{Lu}\p{Lo}]") & ~t.rlike(r"[.!?,;:\-]$")
    headers = in_band.join(keys, [*flow, "key"], "left").withColumn("margin", F.when(F.coalesce("again", F.lit(False)) | shaped, "running_header"))
    headers = cut(headers.select(*base.columns, "key"))
    known = headers.where("margin is not null").select(*flow, "key").distinct().withColumn("known", F.lit(True))
    # only rows of unknown height, which are few, look at their page and at the headers of their flow
    lone = base.where("unsure = 1").withColumn("key", _header_key(t))
    pages = lone.select(*flow, "page").distinct()
    ends = base.where(~contents).select(*flow, "page", "seq").join(pages, [*flow, "page"], "left_semi").groupBy(*flow, "page").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    judged = lone.join(ends, [*flow, "page"], "left").join(known, [*flow, "key"], "left")
    edge = (F.col("seq") == F.col("lo")) | (F.col("seq") == F.col("hi"))
    judged = judged.withColumn("margin", F.when(edge & (F.col("margin") == "page_number"), "page_number").when(edge & F.col("known"), "running_header"))
    out = base.drop("unsure").columns
    return base.where("unsure = 0").select(*out).unionByName(cut(headers.select(*out).unionByName(judged.select(*out))))


def following(body: DataFrame) -> DataFrame:
    """(source_table, row_id, flow, a, sign, b, next): rows whose text ends with a hyphen.

    ``a`` is the word before the hyphen, ``b`` the first word of the next row in reading order and
    ``next`` the hash of that row's text. Ordered within a page, and pages within a flow, so that
    no flow is a single task; only hashes (a flow's own among them) and the two words travel. Contents lines that several
    rows share count as one row: the next one is the next row with another text.
    """
    keys = ["f", "page"]
    last = rf"([\p{{L}}\p{{M}}'’]+)([{HYPHENS}])\s*$"
    ends = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1).isin(*HYPHENS)
    word = lambda k: F.when(ends, F.lower(F.regexp_extract("text", last, k))).otherwise("")
    flow = F.xxhash64("source_table", "flow").alias("f")
    slim = body.select(flow, "page", "row_id", "seq", (F.col("source_table") == REPORT).alias("shared"), F.xxhash64("text").alias("h"), F.when(ends, F.col("source_table")).alias("source_table"), F.when(ends, F.col("flow")).alias("flow"), word(1).alias("a"), word(2).alias("sign"), F.substring_index(F.ltrim("text", F.lit(" \t\n\x0b\f\r")), " ", 1).alias("b"))
    here = F.struct("b", "h")
    by = Window.partitionBy(*keys).orderBy("seq")
    # a row's next text in its page; rows that repeat the text before them are passed over
    after = F.first(F.when(F.col("changed"), here), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    shared = F.col("shared")
    changed = ~shared | F.coalesce(F.lag("h").over(by) != F.col("h"), F.lit(True))
    ordered = slim.withColumn("changed", changed).withColumn("x", F.when(shared, after).otherwise(F.lead(here).over(by))).withColumn("n", F.row_number().over(by))
    few = cut(ordered.where("sign <> '' or n = 1").select(*keys, "source_table", "flow", "row_id", "a", "sign", "x", "n", here.alias("head")))
    heads = few.where("n = 1").select(*keys, F.lead("head").over(Window.partitionBy("f").orderBy("page")).alias("next_page"))
    full = few.where("sign <> ''").join(heads, keys, "left").withColumn("x", F.coalesce("x", "next_page")).where("x is not null")
    # of most rows the first word is never asked for, so its letters are only looked for here
    first = F.lower(F.regexp_extract("x.b", r"^[“\"«(]*([\p{L}\p{M}]+)", 1))
    return full.select("source_table", "row_id", "flow", "a", "sign", first.alias("b"), F.col("x.h").alias("next"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def originals(word: str, confusions: tuple[tuple[str, str], ...] = CONFUSIONS) -> dict[str, int]:
    """Words that may have been misread as ``word``, with the number of confusions.

    Two confusions at every length; where digits or signs stand among the letters, each of them
    (up to four) and one more.
    """
    signs = sum(c in SIGNS for c in word)
    edits = max(2, min(signs, 4) + 1)
    found, edge = {word: 0}, {word}
    for n in range(1, edits + 1):
        new = set()
        for w in edge:
            for seen, true in confusions:
                at = w.find(seen)
                while at >= 0:
                    x = w[:at] + true + w[at + len(seen) :]
                    # what has more signs left than confusions can't become a word
                    if x not in found and sum(c in SIGNS for c in x) <= edits - n:
                        found[x] = n
                        new.add(x)
                    at = w.find(seen, at + 1)
        edge = new
    del found[word]
    return found


def used(seen: str, true: str) -> dict[int, float] | None:
    """The fewest confusions that turn ``true`` into ``seen``: number -> weight."""
    # by how much of ``seen`` is read: how much of ``true`` that explains, at what cost, by which confusions
    reached: list[dict[int, tuple[float, tuple[int, ...]]]] = [{} for _ in range(len(seen) + 1)]
    reached[0][0] = (0.0, ())
    for i in range(len(seen)):
        for j, (cost, path) in reached[i].items():
            ways = [(1, 1, cost, path)] if true[j : j + 1] == seen[i] else []
            ways += [(len(a), len(b), cost + (AGAIN if k in path else 1.0), (*path, k)) for k, (a, b) in enumerate(CONFUSIONS) if seen.startswith(a, i) and true.startswith(b, j)]
            for x, y, more, steps in ways:
                if j + y not in reached[i + x] or more < reached[i + x][j + y][0]:
                    reached[i + x][j + y] = (more, steps)
    if len(true) not in reached[-1]:
        return None
    weights: dict[int, float] = {}
    for k in reached[-1][len(true)][1]:
        weights[k] = weights[k] + AGAIN if k in weights else 1.0
    return weights


USES = T.ArrayType(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("w", T.DoubleType())]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _originals(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in words:
        yield s.map(lambda w: [x for x in originals(w) if x.isalpha()])


@F.pandas_udf(USES)
def _uses(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for seen, true in pairs:
        yield pd.Series([None if (u := used(a, b)) is None else [{"c": c, "w": v} for c, v in u.items()] for a, b in zip(seen, true)])


def misreadings(counts: DataFrame) -> DataFrame:
    """(seen, n_seen, own, signs, options): words that a more frequent word may explain, with (minus: its count below zero, word, uses) of every explanation.

    ``counts`` has (word, n). ``own`` is how often the word was seen beside the place that is judged,
    less what recurring misreadings of its most frequent original may come to; a word with a digit or sign
    among its letters has none. Words of two letters and less are too alike to be told apart,
    unless a digit or sign stands among the letters.
    """
    odd = F.col("word").rlike(r"\p{L}[0-9@|!]|[0-9@|!]\p{L}")
    latin = F.col("word").rlike(r"^[\p{IsLatin}0-9@|!]+$") & F.col("word").rlike(r"\p{L}")
    asked = counts.where(latin & ((F.length("word") >= 3) | odd)).withColumn("odd", odd)
    asked = asked.select(F.col("word").alias("seen"), F.col("n").alias("n_seen"), "odd", F.explode(_originals("word")).alias("o"))
    known = counts.select(F.col("word"), F.col("n"))
    pairs = asked.withColumnRenamed("o", "word").join(known, "word")
    # how a word was misread is only asked of words that there are
    likely = pairs.where(F.when(F.col("odd"), F.col("n") >= 2).otherwise(F.col("n") > F.col("n_seen")))
    likely = likely.withColumn("uses", _uses("seen", "word")).where("uses is not null")
    own = F.when(F.first("odd"), 0.0).otherwise(F.greatest(F.lit(0.0), F.first("n_seen") - 1 - RECURS * F.max("n")))
    signs = F.length("seen") - F.length(F.regexp_replace("seen", f"[{re.escape(''.join(sorted(SIGNS)))}]", ""))
    return likely.groupBy("seen").agg(F.first("n_seen").alias("n_seen"), own.alias("own"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word", "uses"))).alias("options")).withColumn("signs", F.greatest(F.lit(0), signs - 1))


def _channel(uses: Column, theta: list[float]) -> Column:
    """Log-probability of a misreading: its confusions' own, weighed."""
    table = F.array(*[F.lit(x) for x in theta])
    return F.aggregate(uses, F.lit(0.0), lambda a, u: a + u["w"] * F.get(table, u["c"]))


def confusion_probabilities(wrong: DataFrame, counts: DataFrame) -> tuple[list[float], float]:
    """Log-probability of every confusion and the rate of all, estimated from the whole corpus by expectation and maximisation.

    A word's misreading is shared out among its originals by their frequency and the confusions' probabilities so
    far; what falls to a confusion is divided by the chances that the corpus's words gave it, both with a first guess added. Only
    a sum for each confusion reaches the driver.
    """
    truths = sorted({b for _, b in CONFUSIONS})
    found = counts.agg(*[F.sum(F.when(F.contains("word", F.lit(b)), F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(b), F.lit("")))))).alias(b) for b in truths]).first()
    chances = [(found[b] or 0) / len(b) for _, b in CONFUSIONS]
    theta, rate = [math.log(FIRST_GUESS)] * len(CONFUSIONS), FIRST_GUESS
    for _ in range(EM_ROUNDS):
        scored = wrong.select("n_seen", "own", "signs", F.transform("options", lambda o: F.struct((F.exp(_channel(o["uses"], theta)) * -o["minus"]).alias("p"), o["uses"].alias("uses"))).alias("o"))
        whole = F.aggregate("o", F.greatest(F.lit(OWN_FLOOR * rate), "own") * F.pow(F.lit(rate), F.col("signs")), lambda a, o: a + o["p"])
        shares = scored.withColumn("whole", whole).select("n_seen", "whole", F.explode("o").alias("o")).select((F.col("n_seen") * F.col("o.p") / F.col("whole")).alias("e"), F.explode("o.uses").alias("u"))
        got = {r["c"]: r["e"] for r in shares.groupBy(F.col("u.c").alias("c")).agg(F.sum(F.col("e") * F.col("u.w")).alias("e")).collect()}
        rate = (sum(got.values()) + FIRST_GUESS * GUESS_WEIGHT) / (sum(chances) + GUESS_WEIGHT)
        theta = [math.log(min(0.2, (got.get(k, 0.0) + FIRST_GUESS * GUESS_WEIGHT) / (chances[k] + GUESS_WEIGHT))) for k in range(len(CONFUSIONS))]
    return theta, rate


def _decode(total: float, rate: float):
    """Viterbi over a line: the channel's log-probabilities and interpolated bigrams; ``tokens``, their counts, the options by position, and the counts of the bigrams that matter."""

    @F.pandas_udf("array<string>")
    def decode(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def line(tokens, options, bigrams) -> list[str]:
            by_pos = {int(o["pos"]): o for o in options}
            pair, single = {}, {}
            for b in bigrams if bigrams is not None else []:
                pair[b["a"], b["b"]] = float(b["n"] or 0)
                single[b["a"]], single[b["b"]] = float(b["na"] or 0), float(b["nb"] or 0)
            for i, o in by_pos.items():
                # what stands here can't bear itself out, nor can what recurring misreadings of an original may come to beside the same words
                for there in ((i - 1, i), (i, i + 1)):
                    if 0 <= there[0] and there[1] < len(tokens):
                        beside = [tuple(x["word"] if k == i else tokens[k] for k in there) for x in o["options"]]
                        here = tuple(tokens[k] for k in there)
                        pair[here] = max(0.0, pair.get(here, 0.0) - 1 - RECURS * max(pair.get(b, 0.0) for b in beside)) if o["own"] else 0.0
            for o in by_pos.values():
                for x in o["options"]:
                    single[x["word"]] = -float(x["minus"])
                single[tokens[int(o["pos"])]] = max(OWN_FLOOR * rate, float(o["own"]))

            def follows(a: str, b: str) -> float:
                # a word that is hardly seen says nothing of the next one
                return math.log(BIGRAM_SHARE * pair.get((a, b), 0.0) / max(1.0, single.get(a, 0.0)) + (1 - BIGRAM_SHARE) * single.get(b, 1.0) / total)

            state: dict[str, tuple[float, list[str]]] = {"": (0.0, [])}
            for i, seen in enumerate(tokens):
                cands = [(seen, 0.0)]
                if i in by_pos:
                    o = by_pos[i]
                    # every further sign in a word is one more confusion
                    cands = [(seen, math.log(rate) * float(o["signs"]))] + [(x["word"], float(x["channel"])) for x in o["options"]]
                near = i in by_pos or i - 1 in by_pos
                new = {}
                for word, cost in cands:
                    # only words beside a doubtful one have several ways; elsewhere nothing is to be weighed
                    score, path = max(((s + (follows(before, word) if near else 0.0), p) for before, (s, p) in state.items()), key=lambda x: x[0])
                    new[word] = (score + cost, [*path, word])
                state = new
            return max(state.values(), key=lambda x: x[0])[1]

        for tokens, options, bigrams in batches:
            yield pd.Series([line(t, o, b) for t, o, b in zip(tokens, options, bigrams)])

    return decode


def _small(big: DataFrame, few: DataFrame, on: list[str], bound: int = 48 << 20) -> DataFrame:
    """``big``'s rows that ``few`` names: ``few`` goes to every executor if its counted bytes are at most ``bound``, else both are shuffled."""
    few = cut(few)
    size = few.agg(F.sum(F.lit(48) + sum((F.octet_length(F.col(c).cast("string")) for c in on), F.lit(0)))).first()[0] or 0
    return big.join(F.broadcast(few) if size <= bound else few, on, "left_semi")


def word_counts(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (word, n) over all rows, a line that rows of a report share once: words, and words with a hyphen inside."""
    text = F.col("text")
    inside = F.when(text.rlike(r"\p{L}-\p{L}"), F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)+"), F.lit(0)))
    both = F.when(inside.isNotNull(), F.concat(_tokens(text), inside)).otherwise(_tokens(text))
    counts = cut(body.where("counted").select(F.explode(both).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    return counts.where(~F.col("word").contains("-")), counts.where(F.col("word").contains("-"))


def corrected(body: DataFrame, parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(source_table, row_id, tokens, decoded) of the lines of which at least one word is misread; ``counts`` are the corpus's, ``parts`` the cut rows."""
    keys = ["source_table", "row_id"]
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    wrong = cut(misreadings(counts))
    theta, rate = confusion_probabilities(wrong, counts)
    wrong = wrong.select("seen", "own", "signs", F.transform("options", lambda o: F.struct(o["minus"].alias("minus"), o["word"].alias("word"), _channel(o["uses"], theta).alias("channel"))).alias("options"))
    # only a word and its place travel; the lines of the doubtful words are fetched afterwards
    at = body.select(*keys, F.posexplode(_tokens(F.col("text"))).alias("pos", "seen")).where((F.length("seen") >= 3) | F.col("seen").rlike("[0-9@|!]"))
    hits = _small(at, wrong.select("seen"), ["seen"]).join(wrong, "seen").groupBy(*keys).agg(F.collect_list(F.struct("pos", "own", "signs", "options")).alias("options"))
    # the last word of a cut line and the first of the next one are pieces of a word
    last = F.when(F.col("text").rlike(rf"\p{{L}}[{HYPHENS}]\s*$"), F.size("tokens") - 1).otherwise(-1)
    first = F.when(F.coalesce("cut_start", F.lit(False)), 0).otherwise(-1)
    # pieces of a wrongly decoded word, set apart by symbols within it, are no misread words
    lines = _starts_cut(body.select(*keys, "flow", "text").join(hits, keys).where(~F.col("text").rlike(r"\p{L}[\p{So}\p{Sk}\ufffd]\p{L}|\ufffd")), parts).withColumn("tokens", _tokens(F.col("text"))).withColumn("last", last).withColumn("first", first)
    lattice = cut(lines.select(*keys, "tokens", F.filter("options", lambda o: (o["pos"] != F.col("last")) & (o["pos"] != F.col("first"))).alias("options")).where(F.size("options") > 0))
    # only the bigrams around a doubtful word are counted, over all rows, under the hash of their words
    one = lattice.select(*keys, "tokens", F.explode("options").alias("o")).select(*keys, F.get("tokens", F.col("o.pos") - 1).alias("before"), F.get("tokens", F.col("o.pos") + 1).alias("after"), F.explode(F.concat(F.array(F.get("tokens", F.col("o.pos"))), F.transform("o.options", lambda x: x["word"]))).alias("w"))
    asked = one.select(*keys, F.explode(F.array(F.struct(F.col("before").alias("a"), F.col("w").alias("b")), F.struct(F.col("w").alias("a"), F.col("after").alias("b")))).alias("p")).select(*keys, "p.a", "p.b").where("a is not null and b is not null").distinct()
    asked = cut(asked.withColumn("h", F.xxhash64("a", "b")))
    tokens = _tokens(F.col("text"))
    # the last word's missing neighbour makes a null, which no pair is
    pairs = body.where("counted").select(tokens.alias("t")).select(F.explode(F.zip_with("t", F.slice("t", F.lit(2), F.size("t")), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))).alias("h"))
    all_pairs = _small(pairs, asked.select("h").distinct(), ["h"]).groupBy("h").agg(F.count("*").alias("n"))
    seen = lambda side: counts.select(F.col("word").alias(side), F.col("n").alias(f"n{side}"))
    told = asked.join(all_pairs, "h", "left").join(seen("a"), "a").join(seen("b"), "b")
    bigrams = told.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "n", "na", "nb")).alias("bigrams"))
    full = lattice.join(bigrams, keys, "left")
    return full.select(*keys, "tokens", _decode(total, rate)("tokens", "options", "bigrams").alias("decoded")).where(F.col("tokens") != F.col("decoded"))


def hyphenated(body: DataFrame, words: DataFrame, seen: DataFrame) -> DataFrame:
    """(source_table, row_id, flow, joined, b, next): body rows whose last word is cut and goes on in the next row.

    A soft hyphen or a not-sign always cuts. Another hyphen does unless the two parts are seen
    with a hyphen inside a line more often than as one word; ``words`` and ``seen`` are the corpus's counts.
    """
    cutrows = cut(following(body).where("b <> ''"))
    asked = cutrows.select(F.explode(F.array(F.concat("a", "b"), F.concat_ws("-", "a", "b"), F.concat("a", F.lit("-")))).alias("word")).distinct()
    heads = seen.groupBy(F.concat(F.substring_index("word", "-", 1), F.lit("-")).alias("word")).agg(F.sum("n").alias("n"))
    counts = cut(seen.unionByName(heads).unionByName(words.select("word", "n")).join(asked, "word", "left_semi"))
    out = cutrows
    for name, key in (("one", F.concat("a", "b")), ("two", F.concat_ws("-", "a", "b")), ("head", F.concat("a", F.lit("-")))):
        out = out.withColumn("word", key).join(counts.withColumnRenamed("n", name), "word", "left").drop("word")
    n = lambda c: F.coalesce(c, F.lit(0))
    compound = (n("two") > n("one")) | ((n("one") == 0) & (n("head") > 0))
    return out.where(F.col("sign").isin("\xad", "¬") | ~compound).select("source_table", "row_id", "flow", F.concat("a", "b").alias("joined"), "b", "next")


def wrong_page_numbers(body: DataFrame) -> DataFrame:
    """Contents lines of which a page number holds a letter, and rows with a number of digits and letters mixed."""
    entry = F.array_compact(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(ENTRY_PAGE), F.lit(k)) for k in (1, 2, 3)])))
    letters = F.exists(entry, lambda x: x.rlike(r"\D") & ~x.rlike(r"^[ivxl]+$|^I$|^$"))
    mixed = F.col("text").rlike("[0-9]") & F.col("text").rlike(r"(?<![\p{L}\p{N}])(?=[0-9lIOoZSBqb]*[0-9])(?=[0-9lIOoZSBqb]*[lIOoZSBqb])[0-9lIOoZSBqb]{2,4}(?![\p{L}\p{N}])")
    return body.where(mixed | ((F.col("source_table") == REPORT) & letters)).select("source_table", "row_id")


def noise(rows: DataFrame) -> DataFrame:
    """(source_table, row_id, noise): every kind of noise of every row.

    Null and blank texts have none. Headers and page numbers have no other kind.
    """
    marked = margins(rows)
    body = marked.where("margin is null").drop("margin")
    counts, compounds = word_counts(body)
    parts = cut(hyphenated(body, counts, compounds))
    wrong = corrected(body, parts, counts).select("source_table", "row_id").unionByName(wrong_page_numbers(body)).distinct()
    return _named(
        marked.where("margin is not null").select("source_table", "row_id", F.col("margin").alias("noise"))
        .unionByName(parts.select("source_table", "row_id", F.lit("hyphenated").alias("noise")))
        .unionByName(wrong.select("source_table", "row_id", F.lit("misread").alias("noise")))
    )


def _starts_cut(body: DataFrame, parts: DataFrame) -> DataFrame:
    """``body`` with ``cut_start``: the row's text is one that a cut row of its flow goes on in."""
    heads = cut(parts.select("source_table", "flow", F.col("next").alias("h")).distinct().withColumn("cut_start", F.lit(True)))
    heads = F.broadcast(heads) if heads.count() <= 400_000 else heads
    return body.withColumn("h", F.xxhash64("text")).join(heads, ["source_table", "flow", "h"], "left").drop("h")


def paragraphs(rows: DataFrame) -> DataFrame:
    """(source_table, flow, page, paragraph, text): the body without noise, as running text.

    Headers and page numbers are left out, cut words joined, misread words replaced. A paragraph
    ends where a line closes a sentence and is clearly shorter than its page's lines; every
    contents line is its own entry. A paragraph bears the number of its first line, and paragraphs
    end with their page, save that a word cut at a page's end is completed there.
    """
    keys = ["source_table", "row_id"]
    marked = margins(rows)
    body = marked.where("margin is null").drop("margin")
    counts, compounds = word_counts(body)
    parts = cut(hyphenated(body, counts, compounds))
    lines = _starts_cut(body, parts)
    fixes = corrected(body, parts, counts).select(*keys, F.filter(F.arrays_zip("tokens", "decoded"), lambda x: x["tokens"] != x["decoded"]).alias("fixes"))
    full = lines.join(fixes, keys, "left").join(parts.select(*keys, F.col("b").alias("tail"), F.lit(True).alias("cut_end")), keys, "left")

    def put(text: Column, fix: Column) -> Column:
        # the misread word, in the three ways that case may have it
        seen, word = fix["tokens"], fix["decoded"]
        return F.replace(F.replace(F.replace(text, seen, word), F.initcap(seen), F.initcap(word)), F.upper(seen), F.upper(word))

    clean = F.when(F.col("fixes").isNotNull(), F.aggregate("fixes", F.col("text"), put)).otherwise(F.col("text"))
    clean = F.when(F.col("cut_end"), F.concat(F.regexp_replace(clean, rf"[{HYPHENS}]\s*$", ""), F.col("tail"))).otherwise(clean)
    clean = F.when(F.col("cut_start"), F.regexp_replace(clean, r"^\s*\S+\s*", "")).otherwise(clean)
    page = Window.partitionBy("source_table", "flow", "page").orderBy("seq")
    whole = Window.partitionBy("source_table", "flow", "page")
    out = full.withColumn("clean", F.trim(clean)).withColumn("width", F.percentile(F.length("text"), F.lit(0.75)).over(whole))
    closes = (F.col("source_table") == REPORT) | (F.col("text").rlike(r"[.!?…。][\"”’»)]*\s*$") & (F.length("text") < 0.8 * F.col("width"))) | (F.col("page").isNull())
    numbered = out.withColumn("closes", F.coalesce(F.lag(closes).over(page), F.lit(True))).withColumn("paragraph", F.max(F.when(F.col("closes"), F.col("seq"))).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    return _named(numbered.where("clean <> ''").groupBy("source_table", "flow", "page", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "clean"))), lambda x: x["clean"]), " ").alias("text")))
