"""Matching headings of two sources without a shared key: collective graph linkage.

Candidates share pieces of their titles (or a page), the weak edges of the candidate graph
are pruned by the weights of their neighbourhood, and what is left is scored by title, page and
level and then by how well the neighbours in reading order match, until nothing changes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.runtime import cut

PAGE_TOLERANCE = 2
MIN_TITLE = 0.86
MIN_SCORE = 0.6
NEIGHBOUR_SHARE = 0.2

# Words that a chapter's number may follow or precede, and words that "&" stands for.
LABELS = r"chapter|kapitel|chapitre|capitulo|capítulo|глава|section|abschnitt|part|teil|appendix|anhang|annexe|apéndice|apêndice"
CONJUNCTIONS = ("and", "und", "et", "y", "e", "и", "u.")
# Characters by the strokes that a misreading confuses (rn and m, ii and u, cl and d, 5 and s ...).
STROKES = {
    "e": "c", "o": "c", "a": "c", "0": "c", "6": "c", "i": "l", "1": "l", "|": "l", "t": "l", "f": "l", "r": "l", "j": "l", "!": "l",
    "u": "ll", "n": "ll", "m": "lll", "d": "cl", "w": "vv", "h": "b", "8": "b", "5": "s", "9": "g", "q": "g", "2": "z", "y": "v", "@": "c",
}


def title_facts(title: str | None) -> tuple[str, str, str, str, bool]:
    """(key, key without conjunctions, numbering, series numeral, truncated) of a title.

    The key has neither markup, label, numbering, leaders, page number, case, accents, white
    space nor punctuation, and writes characters by their strokes. A null title has empty facts.
    """
    t = re.sub(r"</?[a-z]+>|\*\*|__", "", title or "")
    t = re.sub(r"[\s\xa0]+", " ", t).strip()
    t = re.sub(r"(?:\s*(?:\.\s?){4,}|\s+…+\s+|\s*·{3,}|\s*_{3,})\s*\d{0,4}$", "", t).strip()
    truncated = bool(re.search(r"(?:\.\.\.|…)$", t))
    t = re.sub(r"[\s.…]+$", "", t)
    low = t.casefold()
    number = ""
    m = re.match(rf"(?:(?:{LABELS})\s*)?((?:\d+[.)]?)+(?:\.\d+)*)[.:)]?\s+(?=\S)|제?\s*(\d+)\s*장\s*", low)
    if m:
        number = (m.group(1) or m.group(2) or "").strip(".)")
        low = low[m.end() :]
    else:
        m = re.match(rf"(?:{LABELS})\s+([ivxlc]+)[.:]?\s+(?=\S)", low)
        low = low[m.end() :] if m else low
    series = ""
    m = re.search(r"\s([ivx]{1,4}|[l1|]{1,3})$", low)
    if m:
        series = re.sub(r"[l1|]", "i", m.group(1))
        low = low[: m.start()]
    plain = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    plain = unicodedata.normalize("NFC", plain)

    def strokes(s: str) -> str:
        return "".join(STROKES.get(c, c) for c in s if c.isalnum() or c in "|!@")

    short = " ".join(w for w in re.split(r"\s+", plain.replace("&", " ")) if w not in CONJUNCTIONS)
    return strokes(plain), (strokes(short) if "&" in plain or any(w in CONJUNCTIONS for w in plain.split()) else ""), number, series, truncated


FACTS = "key string, short string, number string, series string, truncated boolean"


def _facts_udf():
    @F.pandas_udf(FACTS)
    def facts(titles: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in titles:
            yield pd.DataFrame([title_facts(t) for t in s], columns=["key", "short", "number", "series", "truncated"])

    return facts


def _grams(key: str) -> Column:
    """Pieces of three strokes; a shorter key is its own piece."""
    n = F.length(key)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(F.col(key), i, F.lit(3))))).otherwise(F.array(F.col(key)))


def _pieces(rows: DataFrame) -> DataFrame:
    """(book, id, gram) of each title, with and without its conjunctions."""
    both = F.when(F.col("short") == "", _grams("key")).otherwise(F.array_union(_grams("key"), _grams("short")))
    return rows.select("book", "id", F.explode(both).alias("gram"))


def _coded(rows: DataFrame, rarity: DataFrame) -> DataFrame:
    """Rows with ``codes``, a whole number for each piece, the rarest piece of the book first.

    The low byte of a code is the piece's weight in tenths, which falls with its share of the book's
    titles; the rest is its hash, so equal pieces of a book have equal codes.
    """
    parts = _pieces(rows).join(rarity, ["book", "gram"])
    lists = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "code"))), lambda x: x["code"]).alias("codes"))
    return rows.join(lists, "id")


def _mass(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0), lambda a, c: a + c.bitwiseAND(F.lit(255)))


def candidates(items: DataFrame, outline: DataFrame) -> DataFrame:
    """(i, o, weight) of pairs of one book that share a rare piece: pages within the tolerance, or one unknown.

    An item's title of n strokes that is MIN_TITLE alike to an outline title, or to the beginning of one, differs in at
    most (1 - MIN_TITLE) n strokes, each of which breaks three pieces at most. So of its pieces all but
    3 (1 - MIN_TITLE) n are in the other title, and at least one of its 3 (1 - MIN_TITLE) n + 1 rarest ones is: those are
    looked up among all pieces of the outline titles, and no alike pair is missed. Rows with a page meet on (book, page,
    piece), a row without one on (book, piece). The weight is the shared pieces' share of the smaller title's weight.
    """
    both = items.select("book", "id", "key", "short").unionByName(outline.select("book", "id", "key", "short"))
    grams = _pieces(both).groupBy("book", "gram").agg(F.count("*").alias("df"))
    total = both.groupBy("book").agg(F.count("*").alias("total"))
    weight = F.least(F.lit(255), F.greatest(F.lit(1), F.round(10 * F.log1p(F.col("total") / F.col("df"))))).cast("int")
    code = F.shiftleft(F.hash("gram").bitwiseAND(F.lit((1 << 23) - 1)), 8).bitwiseOR(weight)
    rarity = cut(grams.join(total, "book").select("book", "gram", "df", code.alias("code")))
    left, right = cut(_coded(items, rarity)), cut(_coded(outline, rarity))
    rare = F.slice("codes", F.lit(1), F.ceil(3 * (1 - MIN_TITLE) * F.length("key")).cast("int") + 1)
    i = left.select("book", F.col("id").alias("i"), "page", F.explode(rare).alias("c"))
    o = right.select("book", F.col("id").alias("o"), "page", F.explode("codes").alias("c"))
    near = i.where("page is not null").withColumn("page", F.explode(F.sequence(F.col("page") - PAGE_TOLERANCE, F.col("page") + PAGE_TOLERANCE)))
    by_page = near.join(o.where("page is not null"), ["book", "page", "c"]).select("i", "o")
    lost_i = i.where("page is null").drop("page").join(o.drop("page"), ["book", "c"]).select("i", "o")
    lost_o = i.where("page is not null").drop("page").join(o.where("page is null").drop("page"), ["book", "c"]).select("i", "o")
    pairs = by_page.unionByName(lost_i).unionByName(lost_o).distinct()
    full = pairs.join(left.select(F.col("id").alias("i"), F.col("codes").alias("ci")), "i").join(right.select(F.col("id").alias("o"), F.col("codes").alias("co")), "o")
    return full.select("i", "o", F.try_divide(_mass(F.array_intersect("ci", "co")), F.least(_mass(F.col("ci")), _mass(F.col("co")))).alias("weight"))


def _placed(rows: DataFrame, within: list[str], first: Column, part: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their number in the order of ``first``, ``part`` and ``order`` within ``within``.

    Numbered within each (first, part) and moved on by the rows before it, so that no book is one task.
    """
    marked = rows.withColumn("__a", first).withColumn("__b", part)
    block = [*within, "__a", "__b"]
    sizes = marked.groupBy(*block).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*within).orderBy("__a", "__b")) - F.col("__n")
    own = F.row_number().over(Window.partitionBy(*block).orderBy(*order))
    return marked.withColumn("pos", own).join(sizes.withColumn("__s", before), block).withColumn("pos", (F.col("pos") + F.col("__s")).cast("int")).drop("__a", "__b", "__n", "__s")


def prune(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """Meta-blocking: an edge stays if it has ``share`` of the best weight at both of its ends."""
    wi, wo = Window.partitionBy("i"), Window.partitionBy("o")
    w = pairs.where("weight > 0").withColumn("bi", F.max("weight").over(wi)).withColumn("bo", F.max("weight").over(wo))
    return w.where((F.col("weight") >= share * F.col("bi")) & (F.col("weight") >= share * F.col("bo"))).select("i", "o", "weight")


def _title_similarity() -> Column:
    def alike(a: Column, b: Column) -> Column:
        longer = F.greatest(F.length(a), F.length(b))
        return F.when(longer == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)

    full = alike(F.col("ki"), F.col("ko"))
    short = F.when((F.col("si") != "") & (F.col("so") != ""), alike(F.col("si"), F.col("so"))).otherwise(0.0)
    # a title that breaks off is compared with the beginning of the other, if enough of it is left
    cut_short = F.length("ki") < F.length("ko")
    head = F.when(cut_short & (F.length("ki") >= 6) & (F.col("ti") | (F.length("ki") >= 0.35 * F.length("ko"))), alike(F.col("ki"), F.substr("ko", F.lit(1), F.length("ki"))) - F.when(F.col("ti"), 0.02).otherwise(0.06)).otherwise(0.0)
    best = F.greatest(full, short, head)
    series_differs = (F.col("ri") != F.col("ro")) & ~(cut_short & (F.col("ri") == "") & (head >= full))
    number_differs = (F.col("ni") != "") & (F.col("no") != "") & (F.col("ni") != F.col("no"))
    return F.when(series_differs, 0.0).otherwise(best - F.when(number_differs, 0.1).otherwise(0.0))


def propagate(edges: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """``edges`` (i, o, book, arm, pi, po, own) with ``score``, in rounds until no score moves by ``tolerance`` or more.

    The rounds end: a score moves by at most NEIGHBOUR_SHARE / 2 for each of its eight neighbours,
    so the largest change falls to 0.8 of itself or less in every round.
    """
    edges = edges.withColumn("score", F.col("own"))
    # neighbours at the same small distance before or behind on both sides bear a pair out
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if a * b > 0]))
    while True:
        shift = edges.select("i", "o", "book", "arm", "pi", "po", steps.alias("s")).select("i", "o", "book", "arm", (F.col("pi") + F.col("s.a")).alias("pi"), (F.col("po") + F.col("s.b")).alias("po"))
        support = shift.join(edges.select("book", "arm", "pi", "po", F.col("score").alias("near")), ["book", "arm", "pi", "po"]).groupBy("i", "o").agg(F.least(F.lit(1.0), F.sum("near") / 2).alias("support"))
        new = edges.join(support, ["i", "o"], "left").withColumn("was", F.col("score")).withColumn("score", (1 - NEIGHBOUR_SHARE) * F.col("own") + NEIGHBOUR_SHARE * F.coalesce("support", F.lit(0.0)))
        new = cut(new)
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        edges = new.drop("was", "support")
        if moved is None or moved < tolerance:
            return edges


def link(items: DataFrame, outline: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(item_id, outline_id, confidence) of the pairs that stand for the same heading.

    ``items`` has (id, book, arm, title, page, level, kind), ``outline`` (id, book, ord, title,
    page, level); rows repeated under an id count once, null books or titles match nothing, null
    pages and levels count neither for nor against. Captions are no headings. An outline row is
    matched by at most one item of each arm and an item by one outline row: the pair whose score
    is the best at both ends goes first, ties to the smaller ids.
    """
    facts = _facts_udf()
    it = items.where("book is not null and title is not null and coalesce(kind, '') <> 'caption'").dropDuplicates(["id"]).withColumn("f", facts("title")).select("id", "book", "arm", "page", "level", "f.*").where("key <> ''")
    ol = outline.where("book is not null and title is not null").dropDuplicates(["id"]).withColumn("f", facts("title")).select("id", "book", "ord", "page", "level", "f.*").where("key <> ''")
    far = F.coalesce("page", F.lit(1 << 30))
    it, ol = cut(it), cut(ol)
    it = cut(_placed(it, ["book", "arm"], far, F.floor(F.col("id") / (1 << 14)), ["id"]))
    ol = cut(_placed(ol, ["book"], F.floor(F.col("ord") / (1 << 12)), F.lit(0), ["ord", "id"]))
    kept = prune(cut(candidates(it, ol)))
    left = it.select(F.col("id").alias("i"), "book", "arm", F.col("pos").alias("pi"), F.col("page").alias("gi"), F.col("level").alias("li"), F.col("key").alias("ki"), F.col("short").alias("si"), F.col("number").alias("ni"), F.col("series").alias("ri"), F.col("truncated").alias("ti"))
    right = ol.select(F.col("id").alias("o"), F.col("pos").alias("po"), F.col("page").alias("go"), F.col("level").alias("lo"), F.col("key").alias("ko"), F.col("short").alias("so"), F.col("number").alias("no"), F.col("series").alias("ro"))
    scored = kept.join(left, "i").join(right, "o").withColumn("title", _title_similarity()).where(F.col("title") >= MIN_TITLE)
    apart = F.abs(F.col("gi") - F.col("go"))
    page = F.coalesce(1 - apart / (2 * PAGE_TOLERANCE), F.lit(0.4))
    level = F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.col("li") - F.col("lo")) / 3), F.lit(0.5))
    own = 0.7 * F.col("title") + 0.2 * page + 0.1 * level
    edges = propagate(cut(scored.select("i", "o", "book", "arm", "pi", "po", own.alias("own"))), tolerance)
    edges = edges.where(F.col("score") >= MIN_SCORE)
    taken = None
    while True:
        bi = Window.partitionBy("i").orderBy(F.desc("score"), "o")
        bo = Window.partitionBy("o", "arm").orderBy(F.desc("score"), "i")
        won = cut(edges.withColumn("x", F.row_number().over(bi)).withColumn("y", F.row_number().over(bo)).where("x = 1 and y = 1").select("i", "o", "arm", "score"))
        if won.limit(1).count() == 0:
            break
        taken = won if taken is None else taken.unionByName(won)
        edges = cut(edges.join(won.select("i"), "i", "left_anti").join(won.select("o", "arm"), ["o", "arm"], "left_anti"))
    taken = won if taken is None else taken
    return taken.select(F.col("i").alias("item_id"), F.col("o").alias("outline_id"), F.round("score", 4).alias("confidence"))
