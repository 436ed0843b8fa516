"""Plans to node graphs: page ownership, split level, links, Markdown, coverage and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.config import MarkdownSplitConfig
from folioweave.functions import text as X
from folioweave.operators import hierarchy as H
from folioweave.operators.outline import nearest_above, parents, ranges


def graph_nodes(plan: DataFrame, totals: DataFrame, mode: str = "direct") -> DataFrame:
    """Nodes of a plan: id, range, content range, parent, previous and next id.

    Direct content runs up to the page before the next item, and is null where that begins on the
    same page; inclusive content is the whole range.
    """
    ranged = parents(ranges(plan, totals))
    by = Window.partitionBy("book_id").orderBy("ord")
    node = lambda c: F.when(c.isNotNull(), F.format_string("n%04d", c))
    nxt = F.lead("pdf_page").over(by)
    end = F.col("end_page") if mode == "inclusive" else F.when(nxt.isNull(), F.greatest("pdf_page", "total")).when(nxt > F.col("pdf_page"), nxt - 1)
    wide = ranged.join(totals.select("book_id", F.col("total_pages").alias("total")), "book_id", "left")
    return wide.select(
        "book_id", "ord", node(F.col("ord")).alias("node_id"), "title", "level", "start_page", "end_page",
        F.when(end.isNotNull(), F.col("pdf_page")).alias("content_start_page"), end.cast("int").alias("content_end_page"),
        node(F.col("parent_ord")).alias("parent_id"), node(F.lag("ord").over(by)).alias("previous_id"), node(F.lead("ord").over(by)).alias("next_id"), "source", "confidence",
    )


def ownership(nodes: DataFrame) -> DataFrame:
    """(book_id, pdf_page, node_id): each page that a node's content holds."""
    return nodes.where("content_start_page is not null and content_end_page >= content_start_page").select("book_id", F.explode(F.sequence("content_start_page", "content_end_page")).alias("pdf_page"), "node_id")


def coverage(nodes: DataFrame, totals: DataFrame, page_words: DataFrame) -> DataFrame:
    """(book_id, assigned, unassigned, duplicated, empty_text) pages of each book, and its nodes without a page of their own."""
    owners = ownership(nodes).groupBy("book_id", "pdf_page").agg(F.count("*").alias("owners"))
    pages = totals.where("total_pages >= 1").select("book_id", F.explode(F.sequence(F.lit(1), "total_pages")).alias("pdf_page"))
    full = pages.join(owners, ["book_id", "pdf_page"], "left").join(page_words, ["book_id", "pdf_page"], "left")
    lone = nodes.groupBy("book_id").agg(F.count_if(F.col("content_start_page").isNull()).alias("n"))
    pages = full.groupBy("book_id").agg(
        F.count_if(F.col("owners") >= 1).alias("assigned_page_count"), F.count_if(F.col("owners").isNull()).alias("unassigned_page_count"),
        F.count_if(F.col("owners") > 1).alias("duplicated_page_count"), F.count_if(F.coalesce("words", F.lit(0)) == 0).alias("empty_text_page_count"),
    )
    return pages.join(lone, "book_id", "left").withColumn("navigation_only_node_count", F.coalesce("n", F.lit(0))).drop("n")


def split_items(plan: DataFrame, totals: DataFrame) -> DataFrame:
    """Every item of a plan in its segment, for every level that the plan can be split at.

    Items at or above ``split_level`` begin a segment, named by its number; items before the first
    belong to none. A segment's content is the pages from its first item up to the page before the next
    segment (``content_start_page``, ``content_end_page``), and null where that begins on the same page.
    """
    deepest = plan.groupBy("book_id").agg(F.max("level").alias("deep"))
    wide = plan.join(deepest, "book_id").withColumn("split_level", F.explode(F.sequence(F.lit(1), F.col("deep").cast("int"))))
    by = Window.partitionBy("book_id", "split_level").orderBy("ord")
    starts = F.col("level") <= F.col("split_level")
    part = wide.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("segment > 0")
    heads = part.where(starts).select("book_id", "split_level", "segment", F.col("ord").alias("start_ord"), F.col("pdf_page").alias("start_page"), F.lead("pdf_page").over(by).alias("__next"))
    heads = heads.join(totals, "book_id", "left").withColumn("__next", F.coalesce("__next", F.col("total_pages") + 1))
    own = F.col("__next") > F.col("start_page")
    heads = heads.select("book_id", "split_level", "segment", "start_ord", "start_page", F.when(own, F.col("start_page")).alias("content_start_page"), F.when(own, F.col("__next") - 1).cast("int").alias("content_end_page"))
    return part.drop("deep").join(heads, ["book_id", "split_level", "segment"])


def chained_ancestors(plan: DataFrame) -> DataFrame:
    """(book_id, ord, above): for every item the ords of the nearest item before it one level up, of the nearest before that one level further up, and so on.

    A level that is missing on the way up ends the chain. Doubled along the links.
    """
    links = nearest_above(plan).select(F.col("book_id").alias("g"), F.col("ord").alias("v"), F.col("ord").alias("node"), F.col("above_ord").alias("p"))
    return H.paths(links).select(F.col("g").alias("book_id"), F.col("v").alias("ord"), F.slice("path", F.lit(1), F.size("path") - 1).alias("above"))


def heading_line(title: Column | str, level: Column | str) -> Column:
    return X.markdown_heading(X.normalized(title), F.col(level) if isinstance(level, str) else level)


def split_segments(plan: DataFrame, totals: DataFrame, page_words: DataFrame) -> DataFrame:
    """(book_id, split_level, segment, start_page, content_start_page, content_end_page, items, words) for every level a plan can be split at.

    Words are those of the content's pages, of the headings of all items of the segment and of the
    headings above its first item; a heading's marks count as a word.
    """
    items = split_items(plan, totals)
    key = ["book_id", "split_level", "segment"]
    head_words = X.word_count(heading_line("title", "level"))
    seg = items.groupBy(*key).agg(
        F.first("start_ord").alias("start_ord"), *[F.first(c).alias(c) for c in ("start_page", "content_start_page", "content_end_page")], F.count("*").alias("items"), F.sum(head_words).alias("heading_words")
    )
    # the chain above an item does not depend on where the plan is split
    above = chained_ancestors(plan).select("book_id", F.col("ord").alias("start_ord"), F.explode("above").alias("ord")).join(plan.select("book_id", "ord", head_words.alias("w")), ["book_id", "ord"])
    above = above.groupBy("book_id", "start_ord").agg(F.sum("w").alias("above_words"))
    pages = seg.where("content_start_page is not null").select(*key, F.explode(F.sequence("content_start_page", "content_end_page")).alias("pdf_page")).join(page_words, ["book_id", "pdf_page"])
    words = pages.groupBy(*key).agg(F.sum("words").alias("page_words"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return (
        seg.join(above, ["book_id", "start_ord"], "left").join(words, key, "left")
        .select(*key, "start_page", "content_start_page", "content_end_page", "items", (n("page_words") + F.col("heading_words") + n("above_words")).alias("words"))
    )


def split_documents(plan: DataFrame, totals: DataFrame, page_texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(book_id, segment, start_ord, ..., content_markdown, word_count) of every segment of the chosen level (book_id, chosen_level).

    A document has the headings above its first item and that item's own; then for each page of its content the headings of the
    items on it that are not out yet, and the page's text under a comment with its number (blank pages have neither); then the
    headings that are left, whose page belongs to the next document. Parts stand apart by blank lines. Words are those of
    headings and texts, comments left out.
    """
    key = ["book_id", "segment"]
    items = split_items(plan, totals).join(chosen.select("book_id", "chosen_level"), "book_id").where("split_level = chosen_level").drop("split_level", "chosen_level")
    line = heading_line("title", "level")
    first = items.where("ord = start_ord")
    lines = plan.select("book_id", "ord", line.alias("line"))
    above = first.select(*key, "start_ord").join(chained_ancestors(plan).withColumnRenamed("ord", "start_ord"), ["book_id", "start_ord"]).select(*key, F.explode("above").alias("ord")).join(lines, ["book_id", "ord"])
    inside = F.col("pdf_page").between(F.col("content_start_page"), F.col("content_end_page"))
    heads = items.select(*key, "ord", F.when(F.col("ord") == F.col("start_ord"), -1).when(inside, F.col("pdf_page")).otherwise(1 << 30).alias("page"), line.alias("line"))
    pages = first.where("content_start_page is not null").select(*key, F.explode(F.sequence("content_start_page", "content_end_page")).alias("pdf_page")).join(page_texts.select("book_id", "pdf_page", "text"), ["book_id", "pdf_page"]).where("text <> ''")
    # kind puts a page's headings before its text
    parts = above.select(*key, F.lit(-2).alias("page"), F.lit(0).alias("kind"), "ord", F.col("line").alias("part"), X.word_count("line").alias("w"))
    parts = parts.unionByName(heads.select(*key, "page", F.lit(0).alias("kind"), "ord", F.col("line").alias("part"), X.word_count("line").alias("w")))
    comment = F.format_string("<!-- pdf_page %d -->\n\n", "pdf_page")
    parts = parts.unionByName(pages.select(*key, F.col("pdf_page").alias("page"), F.lit(1).alias("kind"), F.lit(0).alias("ord"), F.concat(comment, F.col("text")).alias("part"), X.word_count("text").alias("w")))
    body = parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "kind", "ord", "part"))), lambda x: x["part"]), "\n\n").alias("md"), F.sum("w").alias("word_count"))
    contained = items.groupBy(*key).agg(F.array_sort(F.collect_list("ord")).alias("contained_ords"))
    shown = first.select(*key, "start_ord", "title", "level", "start_page", "content_start_page", "content_end_page", "source", "confidence")
    return shown.join(body, key).join(contained, key).withColumn("content_markdown", F.concat(F.regexp_replace("md", r"\s+$", ""), F.lit("\n"))).drop("md")


def split_nodes(documents: DataFrame) -> DataFrame:
    """Documents as graph nodes: ids and order by segment, parents by level, previous and next in order, and the ids of the plan items that each holds.

    A node's id is that of the plan item that begins it.
    """
    node = lambda c: F.when(c.isNotNull(), F.format_string("n%04d", c))
    by = Window.partitionBy("book_id").orderBy("ord")
    ranked = documents.withColumn("ord", F.col("start_ord"))
    up = parents(ranked.select("book_id", "ord", "level")).select("book_id", "ord", "parent_ord")
    wide = ranked.join(up, ["book_id", "ord"])
    return wide.select(
        "book_id", node(F.col("ord")).alias("node_id"), F.row_number().over(by).alias("ord"), "title", "level", "start_page", F.coalesce("content_end_page", "start_page").alias("end_page"), "content_start_page", "content_end_page",
        node(F.col("parent_ord")).alias("parent_id"), node(F.lag("ord").over(by)).alias("previous_id"), node(F.lead("ord").over(by)).alias("next_id"),
        F.transform("contained_ords", lambda o: F.format_string("n%04d", o)).alias("contained_ids"), "word_count", "content_markdown", "source", "confidence",
    )


def split_statistics(segments: DataFrame, max_words: int) -> DataFrame:
    """Counts, whole-number percentiles, mean and coverage of the segments of each level."""
    w = F.col("words")
    pct = lambda q: F.percentile(w, F.lit(q)).cast("int")
    return segments.groupBy("book_id", "split_level").agg(
        F.count("*").alias("segments"), F.sum(w).alias("words"), F.min(w).alias("min_words"), pct(0.5).alias("p50"), pct(0.9).alias("p90"), pct(0.95).alias("p95"), F.max(w).alias("max_words"),
        F.round(F.avg(w), 1).alias("mean_words"), F.round(F.avg((w <= max_words).cast("double")), 4).alias("coverage"), F.count_if(w > max_words).alias("overflow"),
    )


def split_level(segments: DataFrame, config: MarkdownSplitConfig = MarkdownSplitConfig()) -> DataFrame:
    """(book_id, chosen_level, fallback): the shallowest level that keeps enough segments small, else the deepest there is."""
    each = segments.groupBy("book_id", "split_level").agg(F.avg((F.col("words") <= config.max_words).cast("double")).alias("c"))
    ok = F.min(F.when(F.col("c") >= config.max_words_coverage, F.col("split_level")))
    return each.groupBy("book_id").agg(F.coalesce(ok, F.max("split_level")).alias("chosen_level"), ok.isNull().alias("fallback"))


def ancestor_titles(plan: DataFrame) -> DataFrame:
    """(book_id, ord, ancestors): titles of the open items above each one, the root first.

    Doubled along the parent links, so the number of joins is the logarithm of the depth.
    """
    links = parents(plan).select(F.col("book_id").alias("g"), F.col("ord").alias("v"), F.col("title").alias("node"), F.col("parent_ord").alias("p"))
    return H.paths(links).select(F.col("g").alias("book_id"), F.col("v").alias("ord"), F.slice("path", F.lit(1), F.size("path") - 1).alias("ancestors"))


# What a node says where it has no link, and no page of its own (a tree's node, a split's node).
NO_LINK = "없음"
NO_PAGES = "이 node가 직접 소유하는 page text는 없습니다. \n하위 내용은 Children link를 따라가서 확인합니다."
NO_CONTENT = "이 segment가 직접 소유하는 page text는 없습니다."


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``file_name`` and the links that others and their children are named by: parent, previous, next, children."""
    named = nodes.withColumn("file_name", X.node_file_name(F.col("ord").cast("int"), F.col("level").cast("int"), F.col("start_page").cast("int"), "title"))
    link = X.wiki_link(F.regexp_replace("file_name", r"\.md$", ""), F.col("title"))
    links = named.select("book_id", "node_id", link.alias("link"))
    kids = named.where("parent_id is not null").select("book_id", F.col("parent_id").alias("node_id"), "ord", F.col("node_id").alias("kid"), link.alias("link"))
    kids = kids.groupBy("book_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kid", "link"))).alias("k"))
    out = named.join(kids, ["book_id", "node_id"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("children", F.coalesce(F.transform("k", lambda x: x["link"]), none)).withColumn("children_ids", F.coalesce(F.transform("k", lambda x: x["kid"]), none)).drop("k")
    for side in ("parent", "previous", "next"):
        out = out.join(links.toDF("book_id", f"{side}_id", side), ["book_id", f"{side}_id"], "left")
    return out


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    """Fields as front matter in YAML: values are written as JSON, which YAML reads as well."""
    value = lambda v: F.coalesce(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit(""))
    lines = [F.concat(F.lit(f"{k}: "), F.when(v.isNull(), "null").otherwise(value(v))) for k, v in fields]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def rendered(nodes: DataFrame, content: Column, mode: str, contained: Column, evidence_count: Column) -> DataFrame:
    """(book_id, node_id, file_name, children_ids, markdown): front matter, heading, navigation and content of every node."""
    full = linked_nodes(nodes)
    c = F.col
    meta = [
        ("schema_version", F.lit(1)), ("node_id", c("node_id")), ("order", c("ord")), ("title", c("title")), ("level", c("level")), ("pdf_start_page", c("start_page")), ("pdf_end_page", c("end_page")),
        ("content_start_page", c("content_start_page")), ("content_end_page", c("content_end_page")), ("content_mode", F.lit(mode)), ("source", c("source")), ("confidence", c("confidence")), ("evidence_count", evidence_count),
        *[(k + s, c(k + s)) for k in ("parent", "previous", "next") for s in ("_id", "")], ("children", c("children")), ("contained_plan_node_ids", contained), ("evidence_ref", F.concat(F.lit("../bookmark_plan.json#"), c("node_id"))),
    ]
    nav = [F.concat(F.lit(f"- {label}: "), F.coalesce(c(k), F.lit(NO_LINK))) for label, k in (("Parent", "parent"), ("Previous", "previous"), ("Next", "next"))]
    kids = F.when(F.size("children") > 0, F.array_join(F.transform("children", lambda x: F.concat(F.lit("  - "), x)), "\n")).otherwise(f"  - {NO_LINK}")
    text = F.concat_ws("\n", front_matter(meta), F.lit(""), F.concat(F.lit("# "), c("title")), F.lit(""), F.lit("## Navigation"), F.lit(""), *nav, F.lit("- Children:"), kids, F.lit(""), F.lit("## Content"), F.lit(""), content)
    return full.select("book_id", "node_id", "ord", "file_name", "children_ids", F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("markdown"))


def node_markdown(nodes: DataFrame, page_texts: DataFrame, mode: str = "direct") -> DataFrame:
    """Files of a tree's nodes; each page that a node owns stands under a comment with its number, blank ones with the comment alone."""
    page = F.format_string("<!-- pdf_page %d -->", "pdf_page")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    owned = ownership(nodes).join(page_texts.select("book_id", "pdf_page", "text"), ["book_id", "pdf_page"], "left").withColumn("part", F.when(text == "", page).otherwise(F.concat(page, F.lit("\n\n"), text)))
    body = owned.groupBy("book_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pdf_page", "part"))), lambda x: x["part"]), "\n\n").alias("body"))
    return rendered(nodes.join(body, ["book_id", "node_id"], "left"), F.coalesce("body", F.lit(NO_PAGES)), mode, F.array(F.col("node_id")), F.lit(0))


def split_markdown(nodes: DataFrame) -> DataFrame:
    """Files of a split's nodes (:func:`split_nodes`)."""
    content = F.regexp_replace(F.coalesce("content_markdown", F.lit("")), r"\s+$", "")
    return rendered(nodes, F.when(content == "", NO_CONTENT).otherwise(content), "bounded", F.col("contained_ids"), F.lit(0))


def toc_markdown(nodes: DataFrame, content_mode: str = "direct", export_mode: str = "tree_graph") -> DataFrame:
    """(book_id, toc): front matter, the links of the roots, and one indented link with its page for each node, in order."""
    full = linked_nodes(nodes).withColumn("link", X.wiki_link(F.regexp_replace("file_name", r"\.md$", ""), F.col("title")))
    flat = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0)).cast("int")), F.lit("- "), F.col("link"), F.format_string(" — PDF page %d", "start_page"))
    root = F.when(F.col("parent_id").isNull(), F.concat(F.lit("- "), F.col("link")))
    got = full.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), root.alias("r"), flat.alias("f")))).alias("s"), F.count("*").alias("n"), F.count_if(F.col("parent_id").isNull()).alias("roots"))
    meta = front_matter([("schema_version", F.lit(1)), ("document_type", F.lit("toc")), ("title", F.lit("Table of Contents")), ("node_count", F.col("n")), ("root_count", F.col("roots")), ("content_mode", F.lit(content_mode)), ("export_mode", F.lit(export_mode))])
    roots, lines = F.array_compact(F.transform("s", lambda x: x["r"])), F.transform("s", lambda x: x["f"])
    join = lambda a: F.array_join(a, "\n")
    return got.select("book_id", F.concat_ws("\n", meta, F.lit(""), F.lit("# Table of Contents"), F.lit(""), F.lit("## Root nodes"), F.lit(""), join(roots), F.lit(""), F.lit("## Flat outline"), F.lit(""), F.concat(join(lines), F.lit("\n"))).alias("toc"))


def manifest(nodes: DataFrame, covered: DataFrame, content_mode: str = "direct") -> DataFrame:
    """(book_id, manifest): a JSON object for each book."""
    cols = ["node_id", "ord", "title", "level", "start_page", "end_page", "content_start_page", "content_end_page", "parent_id", "previous_id", "next_id"]
    rows = nodes.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*cols).alias("n")))).alias("s"), F.count("*").alias("node_count"), F.count_if(F.col("parent_id").isNull()).alias("root_count"))
    cov = F.struct("assigned_page_count", "unassigned_page_count", "duplicated_page_count", "empty_text_page_count")
    return rows.join(covered, "book_id", "left").select("book_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(content_mode).alias("content_mode"), "node_count", "root_count", cov.alias("coverage"), F.transform("s", lambda x: x["n"]).alias("nodes"))).alias("manifest"))


def graph_validation(nodes: DataFrame, group: str) -> DataFrame:
    """(group, nodes, duplicate_ids, dangling_parents, dangling_children, asymmetric_children, asymmetric_next, unreachable).

    ``nodes`` has the group, node_id, parent_id, children_ids, previous_id and next_id; ids are
    compared without case and outer blanks.
    """
    k = H.node_key
    n = nodes.where(F.col("node_id").isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), k("node_id").alias("v"), k("parent_id").alias("p"), F.transform("children_ids", k).alias("kids"), k("previous_id").alias("prev"), k("next_id").alias("next"))
    ids = n.select("g", "v").distinct()
    dup = n.groupBy("g", "v").count().groupBy("g").agg(F.count_if(F.col("count") > 1).alias("duplicate_ids"), F.sum("count").alias("nodes"))
    child = n.select("g", "v", F.explode("kids").alias("c")).distinct()
    named = n.where("p is not null").select("g", F.col("p").alias("v"), F.col("v").alias("c")).distinct()
    nxt = n.where("next is not null").select("g", "v", F.col("next").alias("c")).distinct()
    prv = n.where("prev is not null").select("g", F.col("prev").alias("v"), F.col("v").alias("c")).distinct()
    per = lambda df, name: df.groupBy("g").agg(F.count("*").alias(name))
    other = ids.select("g", F.col("v").alias("c"))
    parts = [
        per(named.join(ids, ["g", "v"], "left_anti"), "dangling_parents"), per(child.join(other, ["g", "c"], "left_anti"), "dangling_children"),
        per(child.join(named, ["g", "v", "c"], "left_anti").unionByName(named.join(child, ["g", "v", "c"], "left_anti")), "asymmetric_children"),
        per(nxt.join(prv, ["g", "v", "c"], "left_anti").unionByName(prv.join(nxt, ["g", "v", "c"], "left_anti")), "asymmetric_next"),
    ]
    states = H.classify_cycles(H.resolve_parents(nodes, group, "node_id", "parent_id", "children_ids"))
    out = dup
    for p in [*parts, per(states.where("state <> 'tree'"), "unreachable")]:
        out = out.join(p, "g", "left")
    names = ["duplicate_ids", "dangling_parents", "dangling_children", "asymmetric_children", "asymmetric_next", "unreachable"]
    return out.select(F.col("g").alias(group), "nodes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
