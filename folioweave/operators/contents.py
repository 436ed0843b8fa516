"""Contents lists and chapters of plain page texts: entries, page maps, paragraphs, pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as X


def roman_value(text: Column) -> Column:
    """Value of a roman number, null where it is none: the sum of its letters, those before a larger one subtracted."""
    letters = F.split(F.upper(text), "")
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0)
    numbers = F.transform(letters, value)
    total = F.aggregate(F.zip_with(numbers, F.slice(numbers, F.lit(2), F.size(numbers)), lambda a, b: F.when(b > a, -a).otherwise(a)), F.lit(0), lambda s, x: s + x)
    return F.when(text.rlike(r"(?i)^[ivxlcdm]+$"), total)


def is_page_number(text: Column | str) -> Column:
    return X.normalized(text).rlike(r"^[-–—\[( ]*(?:\d{1,4}|(?i:[ivxlc]{1,7}))[-–—\]) ]*$")


def entries(lines: DataFrame, text: str = "raw_line") -> DataFrame:
    """``lines`` with ``entry_no``, ``entry_title`` and ``entry_page`` for each entry in a contents line."""
    out = lines.select("*", F.posexplode(F.split(F.col(text), r"\s+[|/I]\s+|(?<=\s\s\d{1,4})\s{2,}")).alias("entry_no", "part"))
    page = F.regexp_extract("part", r"(\d{1,4})\s*$", 1)
    title = X.normalized(F.regexp_replace("part", r"(?:[.\s•·…]*)\d{1,4}\s*$", ""))
    return out.withColumn("entry_title", title).withColumn("entry_page", F.when(page != "", page.cast("int"))).drop("part")


def printed_page_map(margin_lines: DataFrame) -> DataFrame:
    """(book_id, printed_page, pdf_page): physical pages on which a number stands alone."""
    n = F.regexp_extract("text", r"(\d{1,4})", 1)
    return margin_lines.where(is_page_number("text") & (n != "")).select("book_id", n.cast("int").alias("printed_page"), "pdf_page").distinct()


def mapped_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``wanted`` (book_id, printed_page, low, high) with the first physical page inside its range, null without one."""
    hit = wanted.join(pages, ["book_id", "printed_page"]).where("pdf_page between low and high").groupBy("book_id", "printed_page", "low", "high").agg(F.min("pdf_page").alias("mapped_page"))
    return wanted.join(hit, ["book_id", "printed_page", "low", "high"], "left")


def filled_pages(rows: DataFrame, group: list[str], order: str, page: str) -> DataFrame:
    """``rows`` (with start_page and end_page of their chapter) with ``inferred_page``.

    A page inside the chapter stands. The others, in order, lie half way (rounded up) between the page given to the row
    before and the next one that stands; behind the last that stands they go on by one, at most to the chapter's end; before the
    first that stands they begin one before it, at the chapter's start at the earliest. A chapter in which no page stands counts up from
    its start. The distance d to the next standing page halves from row to row, so the k-th row of a run is d / 2^k before it: no fold is needed.
    """
    p, lo, hi = F.col(page), F.col("start_page"), F.col("end_page")
    stands = F.coalesce(p.isNotNull() & (p > 0) & (lo.isNull() | (p >= lo)) & (hi.isNull() | (p <= hi)), F.lit(False))
    w = Window.partitionBy(*group).orderBy(order)
    near = rows.withColumn("__ok", F.when(stands, p)).withColumn("__n", F.row_number().over(w))
    last = F.last(F.when(F.col("__ok").isNotNull(), F.struct("__ok", "__n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("__b", last).withColumn("__f", F.first("__ok", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    k = F.col("__n") - F.coalesce("__b.__n", F.lit(0))
    before, after = F.col("__b.__ok"), F.col("__f")
    halved = lambda d, times: F.floor(d / F.pow(F.lit(2.0), times))
    head = F.greatest(lo, after - 1)
    inferred = (
        F.when(before.isNotNull() & after.isNotNull(), after - halved(after - before, k))
        .when(before.isNotNull(), F.least(before + k, hi))
        .when(after.isNotNull(), after - halved(after - head, k - 1))
        .otherwise(F.when(k == 1, lo).otherwise(F.least(lo + k - 1, hi)))
    )
    return near.withColumn("inferred_page", F.coalesce("__ok", inferred).cast("int")).drop("__ok", "__n", "__b", "__f")


def chapter_of_page(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """``pages`` with the chapter whose closed range holds the page; of several the latest to start, then the highest number."""
    owned = chapters.where("start_page is not null and end_page >= start_page").select("report_id", F.explode(F.sequence("start_page", "end_page")).alias("page"), F.struct("start_page", "chapter").alias("k"))
    best = owned.groupBy("report_id", "page").agg(F.max("k").alias("k"))
    return pages.join(best, ["report_id", "page"], "left").select(*pages.columns, F.col("k.chapter").alias("owner_chapter"))


# How a chapter begins, in Korean and in English; what a contents page and a chapter's first page say; a subsection's number; exercises.
CHAPTER_KO = r"^\s*(?:제\s*)?(\d{1,3})\s*(?:장|잠)(.*)$"
CHAPTER_EN = r"(?i)^\s*(?:chapter|chap\.)\s+(\d{1,3}|[ivxlcdm]+)(.*)$"
CONTENTS_WORDS = r"(?i)목차|contents|table\s+of\s+contents"
OPENER_WORDS = r"(?i)무엇을\s*배우|왜\s*필요|언제\s*필요|what\s+you|why\s+(?:is|do)|introduction"
SUBSECTION = r"^\s*(\d{1,3})\s*[.-]\s*(\d{1,3}(?:\s*[.-]\s*\d{1,3})?)\s*(.*)$"
EXERCISES = r"^\s*(?:[<〈]?\s*)연습문제"
PARTICLE = r"^(?:의|에서|을|를|이|가|그|과)\s"


def clean_title(title: Column) -> Column:
    """A title without odd blanks, outer signs and a page number at its end."""
    ends = lambda t: F.regexp_replace(t, r"^[ \-:|_]+|[ \-:|_]+$", "")
    return ends(F.regexp_replace(ends(F.regexp_replace(title, r"\s+", " ")), r"(?i)\s+(?:page\s*)?\d{1,4}\s*$", ""))


def _chapter(line: Column) -> tuple[Column, Column]:
    """Number of the chapter that a line opens, null if none, and the rest of the line."""
    ko, en = F.regexp_extract(line, CHAPTER_KO, 1), F.regexp_extract(line, CHAPTER_EN, 1)
    number = F.when(ko != "", ko.cast("int")).when(en.rlike(r"^\d+$"), F.try_to_number(en, F.lit("999")).cast("int")).when(en != "", roman_value(en))
    return number, F.when(ko != "", F.regexp_extract(line, CHAPTER_KO, 2)).otherwise(F.regexp_extract(line, CHAPTER_EN, 2))


def _following(lines: Column, stops: Column, most: int) -> Column:
    """Up to ``most`` of ``lines`` put together, until one stops; ``stops(line)`` is "skip", "stop" or null."""
    empty = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("parts"))

    def put(acc: Column, line: Column) -> Column:
        what = stops(line)
        over = acc["over"] | (F.size(acc["parts"]) >= most) | F.coalesce(what == "stop", F.lit(False))
        return F.struct(over.alias("over"), F.when(over | F.coalesce(what == "skip", F.lit(False)), acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.trim(line)))).alias("parts"))

    return clean_title(F.array_join(F.aggregate(lines, empty, put)["parts"], " "))


def chapter_candidates(page_texts: DataFrame) -> DataFrame:
    """(book_id, pdf_page, number, title, score, standalone, toc_like, line): lines among a page's first 24 that open a chapter.

    A line that is the marker alone scores 5 and takes its title from the lines below; a place among the first five lines 3, among the
    first fourteen 1; a title of three characters 1; a page of eight lines 1; the words of a first page 2. A page that reads like
    contents (says so, or names three chapters) loses 8, a page number at the end of the line 1. Without a title it is "Chapter n".
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\R"), lambda l: F.regexp_replace(l, r"\s+$", "")), lambda l: F.trim(l) != "")
    pages = page_texts.select("book_id", "pdf_page", lines.alias("lines"))
    found = pages.select("*", F.posexplode(F.slice("lines", F.lit(1), F.lit(24))).alias("at", "raw")).withColumn("line", F.trim("raw"))
    number, rest = _chapter(F.col("line"))
    found = found.withColumn("number", number).where("number is not null").withColumn("rest", rest)
    standalone = F.trim("rest") == ""

    def stops(line: Column) -> Column:
        t = F.trim(line)
        return F.when(is_page_number(t), "skip").when(_chapter(t)[0].isNotNull() | t.rlike(r"^[•*-]") | (F.length(t) > 100), "stop")

    below = _following(F.slice("lines", F.col("at") + 2, F.lit(3)), stops, 2)
    title = F.when(standalone, below).otherwise(clean_title(F.col("rest")))
    found = found.withColumn("standalone", standalone).withColumn("title", F.when(title == "", F.concat(F.lit("Chapter "), "number")).otherwise(title))
    page = Window.partitionBy("book_id", "pdf_page")
    distinct = F.size(F.collect_set("number").over(page))
    head = lambda n: F.array_join(F.slice("lines", F.lit(1), F.lit(n)), " ")
    place = F.array_position(F.transform("lines", lambda l: F.trim(l)), F.col("line")) - 1
    part = lambda c, n: F.when(c, n).otherwise(0)
    rated = found.withColumn("toc_like", head(40).rlike(CONTENTS_WORDS) | (distinct >= 3)).withColumn("place", place)
    score = (
        part(F.col("standalone"), 5) + F.when(F.col("place") < 5, 3).when(F.col("place") < 14, 1).otherwise(0) + part(F.length("title") >= 3, 1) + part(F.size("lines") >= 8, 1)
        + part(head(30).rlike(OPENER_WORDS), 2) - part(F.col("toc_like"), 8) - part(F.col("line").rlike(r"\s\d{1,4}$"), 1)
    )
    return rated.select("book_id", "pdf_page", "number", "title", score.alias("score"), "standalone", "toc_like", F.col("at").alias("line_no"), "line")


def chapter_boundaries(candidates: DataFrame, minimum_score: int = 5) -> DataFrame:
    """(book_id, number, start_page, title, score): where each chapter begins, one chapter a page.

    A number's best candidate counts, of equals the earliest page, if it scores enough. A number without one is put in between its
    neighbours: the first of its candidates behind all chapters of smaller numbers and before all strong ones of larger
    numbers, those put in before it included. Pages that read like contents give none.
    """
    option = F.struct("pdf_page", (-F.col("score")).alias("minus"), "title")
    strong = F.max_by(F.struct("pdf_page", "score", "title"), F.when(F.col("score") >= minimum_score, F.struct(F.col("score").alias("s"), (-F.col("pdf_page")).alias("p"), (-F.col("line_no")).alias("l"))))
    each = candidates.where("not toc_like").groupBy("book_id", "number").agg(strong.alias("best"), F.max("score").alias("top"), F.array_sort(F.collect_list(option)).alias("options"))
    each = each.withColumn("best", F.when(F.col("top") >= minimum_score, F.col("best")))
    later = Window.partitionBy("book_id").orderBy("number").rowsBetween(1, Window.unboundedFollowing)
    each = each.withColumn("upper", F.coalesce(F.min("best.pdf_page").over(later), F.lit(1 << 30)))
    # chapters of one book, in order: each one's choice depends on the pages chosen before it
    books = each.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("number", "best", "options", "upper"))).alias("c"))
    start = F.struct(F.lit(0).alias("low"), F.array().cast("array<struct<number:int,page:int,title:string,score:int>>").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        fits = F.get(F.filter(c["options"], lambda o: (o["pdf_page"] > acc["low"]) & (o["pdf_page"] < c["upper"])), F.lit(0))
        page = F.coalesce(c["best"]["pdf_page"], fits["pdf_page"])
        one = F.struct(c["number"].alias("number"), page.cast("int").alias("page"), F.when(c["best"].isNotNull(), c["best"]["title"]).otherwise(fits["title"]).alias("title"), F.coalesce(c["best"]["score"], -fits["minus"]).cast("int").alias("score"))
        return F.when(page.isNull(), acc).otherwise(F.struct(F.greatest(acc["low"], page).cast("int").alias("low"), F.concat(acc["out"], F.array(one)).alias("out")))

    chosen = books.select("book_id", F.explode(F.aggregate("c", start, put)["out"]).alias("x")).select("book_id", "x.number", F.col("x.page").alias("start_page"), "x.title", "x.score")
    first = Window.partitionBy("book_id", "start_page").orderBy("number")
    return chosen.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def subsections(page_texts: DataFrame, chapters: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(book_id, chapter, number, title, pdf_page, line_no, raw_line): numbered subsections in the text of each chapter (book_id, number, start_page, end_page).

    A title that the line lacks is taken from the next two lines. Titles of under 2 or over 100 characters, without
    a letter, with a digit, ending like a sentence or beginning with a particle are none. From a chapter's exercises on nothing counts. Of equal numbers
    on a page the first counts; with ``allowed`` (book_id, subsection) only those do, each once a chapter.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\R"), lambda l: F.regexp_replace(l, r"\s+$", ""))
    pages = chapters.select("book_id", F.col("number").alias("chapter"), F.explode(F.sequence("start_page", "end_page")).alias("pdf_page")).join(page_texts.select("book_id", "pdf_page", lines.alias("lines")), ["book_id", "pdf_page"])
    rows = pages.select("*", F.posexplode("lines").alias("line_no", "raw")).withColumn("raw_line", F.trim("raw"))
    ends = rows.where(F.col("raw").rlike(EXERCISES)).groupBy("book_id", "chapter").agg(F.min(F.struct("pdf_page", "line_no")).alias("end"))
    hit = rows.where(F.col("raw_line").rlike(SUBSECTION)).join(ends, ["book_id", "chapter"], "left").where(F.col("end").isNull() | (F.struct("pdf_page", "line_no") < F.col("end")))
    group = lambda k: F.regexp_extract("raw_line", SUBSECTION, k)
    hit = hit.where(group(1).cast("int") == F.col("chapter"))
    below = _following(F.slice("lines", F.col("line_no") + 2, F.lit(2)), lambda l: F.when((F.trim(l) == "") | (F.length(F.trim(l)) > 100) | F.trim(l).rlike(SUBSECTION), "stop"), 2)
    title = F.when(F.trim(group(3)) != "", clean_title(group(3))).otherwise(F.when(below == "", "Untitled subsection").otherwise(below))
    number = F.concat(group(1), F.lit("."), F.regexp_replace(group(2), r"\s+", ""))
    found = hit.select("book_id", "chapter", number.alias("number"), title.alias("title"), "pdf_page", "line_no", "raw_line")
    t = F.col("title")
    found = found.where(F.length(t).between(2, 100) & t.rlike(r"\p{L}") & ~t.rlike(r"\d|[.!?]$") & ~t.rlike(PARTICLE))
    key = ["book_id", "chapter", "number"]
    if allowed is not None:
        found = found.join(allowed.select("book_id", F.col("subsection").alias("number")).distinct(), ["book_id", "number"], "left_semi")
    else:
        key = [*key, "pdf_page"]
    first = Window.partitionBy(*key).orderBy("pdf_page", "line_no")
    return found.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def unwrapped(page_texts: DataFrame) -> DataFrame:
    """(book_id, pdf_page, block, kind, text): page lines as headings, list items, table rows and joined paragraphs.

    A line that is none of the others goes on in the paragraph of the line before it, unless a
    blank line or another kind stands between.
    """
    lines = page_texts.select("book_id", "pdf_page", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    t = F.trim("line")
    kind = F.when(t == "", "blank").when(t.rlike(r"^#{1,6}\s"), "heading").when(t.rlike(r"^(?:[-*•]|\d+[.)])\s"), "item").when(t.rlike(r"^\|.*\|$|\t| {3,}\S+ {3,}"), "row").otherwise("text")
    by = Window.partitionBy("book_id", "pdf_page").orderBy("n")
    k = lines.withColumn("kind", kind)
    new = F.when((F.col("kind") == "text") & (F.lag("kind").over(by) == "text"), 0).otherwise(1)
    part = k.withColumn("block", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'blank'")
    return part.groupBy("book_id", "pdf_page", "block").agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("l")))), lambda x: x["l"]), " ").alias("text"))


def text_pieces(text: Column | str, most: int = 1900) -> Column:
    """A text's blank-line blocks put together, in order, into pieces of at most ``most`` characters; longer blocks are cut."""
    blocks = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda b: F.regexp_extract_all(F.trim(b), F.lit(rf"(?s).{{1,{most}}}"), F.lit(0))))
    empty = F.array().cast("array<string>")

    def put(acc: Column, block: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, F.lit("\n\n"), block)
        return F.when((F.size(acc) > 0) & (F.length(joined) <= most), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(block)))

    return F.aggregate(blocks, empty, put)


def class_counts(text: Column | str) -> list[Column]:
    """Hangul, Latin, digit and odd characters of a text."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.regexp_count(t, F.lit(p)).alias(n) for n, p in (("hangul", "[가-힣]"), ("latin", "[A-Za-z]"), ("digits", "[0-9]"), ("odd", r"[^\s\p{L}\p{N}\p{P}]"))]
