"""Positioned words to lines, blocks and Markdown.

Input is a table of words: doc_id, page, block, paragraph, line, pos (input order), text, left, top,
width, height, confidence. All of it is set-based, up to the blocks of a page: lines carry the measures of
their page, and get their labels, places and paragraphs by windows over it."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import extent_factor, heading_level, join_lines, let, list_item, stripped

LINE = ["doc_id", "page", "block", "paragraph", "line"]
PAGE = ["doc_id", "page"]
#: A gap of so many character widths parts two cells.
CELL_GAP = 2.6
#: The share is a decimal, so that a stretch of just that share of a page counts as one, as it should: 1400 * 0.035 is over 49 in doubles.
GUTTER_SHARE, GUTTER_LINES = Decimal("0.035"), 6
#: Columns that a table may have.
TABLE_COLUMNS = 10


def recognised(words: DataFrame) -> DataFrame:
    """Words with text and with a confidence that is a number and not negative."""
    confidence = F.col("confidence").cast("string").try_cast("double")
    return words.where((F.trim("text") != "") & (confidence >= 0)).withColumn("confidence", confidence)


def lines(words: DataFrame) -> DataFrame:
    """A row for each visual line: its words by position, and its geometry."""
    word = F.struct("left", "pos", "text", "width")
    out = words.groupBy(*LINE).agg(
        F.sort_array(F.collect_list(word)).alias("words"),
        F.min("left").alias("left"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.min("top").alias("top"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.median("height").alias("height"),
        F.avg("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_words"),
    )
    out = out.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " ")).withColumn("span", F.col("bottom") - F.col("top"))
    return out.withColumn("norm_height", F.col("span") / extent_factor(F.col("text")))


def body_heights(line: DataFrame) -> DataFrame:
    """doc_id, body_height: median height of lines, each counted once for every word."""
    return line.groupBy("doc_id").agg(F.percentile("norm_height", F.lit(0.5), F.col("n_words")).alias("body_height"))


def char_widths(words: DataFrame, by: Iterable[str] = PAGE) -> DataFrame:
    """char_width by page (or ``by``): median over words of two letters or more; 8.0 where there is none."""
    long = F.when(F.length("text") > 1, F.col("width") / F.length("text"))
    return words.groupBy(*by).agg(F.coalesce(F.median(long), F.lit(8.0)).alias("char_width"), F.coalesce(F.median("width"), F.lit(0.0)).alias("word_width"))


def margins(line: DataFrame, widths: DataFrame) -> DataFrame:
    """threshold by block: where a line must reach to have wrapped. The right end at nine tenths of the
    sorted ends (by truncated index), less the wider of a cell gap and 1.3 word widths."""
    ends = line.groupBy(*PAGE, "block").agg(F.sort_array(F.collect_list("right")).alias("rights"))
    at = F.get("rights", F.floor(F.size("rights") * 0.9).cast("int"))
    allowance = F.greatest(F.col("char_width") * CELL_GAP, F.col("word_width") * 1.3)
    return ends.join(widths, PAGE).select(*PAGE, "block", (at - allowance).alias("threshold"))


def with_char_width(words: DataFrame) -> DataFrame:
    """Words with the char_width of ``char_widths``. Those that are dealt by doc_id stay where they are, and are made once."""
    long = F.when(F.length("text") > 1, F.col("width") / F.length("text"))
    return words.withColumn("char_width", F.coalesce(F.median(long).over(Window.partitionBy(*PAGE)), F.lit(8.0)))


def cells(words: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """A row for each cell of a line: words (with char_width, or of ``widths``) part where the gap before one is wider than CELL_GAP characters."""
    order = Window.partitionBy(*LINE).orderBy("left", "pos")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(order)
    x = words if widths is None else words.join(widths, PAGE)
    x = x.withColumn("opens", (gap > F.col("char_width") * CELL_GAP).cast("int"))
    x = x.withColumn("cell", F.coalesce(F.sum("opens").over(order), F.lit(0)))
    out = x.groupBy(*LINE, "cell").agg(F.min("left").alias("x"), F.sort_array(F.collect_list(F.struct("left", "pos", "text"))).alias("w"))
    return out.select(*LINE, "cell", "x", F.array_join(F.transform("w", lambda v: v["text"]), " ").alias("text"))


def table_runs(counts: Column) -> Column:
    """array<struct<start, length>> of the runs in an array of cell counts. A run opens at a line of two
    cells or more, takes lines whose count is two or more and within one of the opening line's, and
    counts with two lines or more. The comparison is with the first line, so this is a fold."""
    kind = "struct<start:int,first:int,n:int,done:array<struct<start:int,length:int>>>"
    nothing = F.array().cast("array<struct<start:int,length:int>>")

    def closed(s: Column) -> Column:
        return F.when(s["n"] >= 2, F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["n"].alias("length"))))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        grows = (s["n"] > 0) & (x["v"] >= 2) & (F.abs(x["v"] - s["first"]) <= 1)
        grown = F.struct(s["start"].alias("start"), s["first"].alias("first"), (s["n"] + 1).alias("n"), s["done"].alias("done"))
        opened = F.struct(x["i"].alias("start"), x["v"].alias("first"), F.lit(1).alias("n"), closed(s).alias("done"))
        none = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("first"), F.lit(0).alias("n"), closed(s).alias("done"))
        return F.when(grows, grown.cast(kind)).when(x["v"] >= 2, opened.cast(kind)).otherwise(none.cast(kind))

    start = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("first"), F.lit(0).alias("n"), nothing.alias("done")).cast(kind)
    numbered = F.transform(counts, lambda v, i: F.struct(v.cast("int").alias("v"), i.cast("int").alias("i")))
    return F.aggregate(numbered, start, step, closed)


def column_anchors(xs: Column) -> Column:
    """Distinct positions reduced to columns: a new one starts over a tolerance beyond the last that
    started, which is 6 % of the spread, 12 at least."""
    far = lambda s, x, tolerance: (F.size(s) == 0) | (x - F.element_at(s, F.greatest(F.size(s), F.lit(1))) > tolerance)
    fold = lambda at, tolerance: F.aggregate(at, F.array().cast("array<double>"), lambda s, x: F.when(F.coalesce(far(s, x, tolerance), F.lit(True)), F.concat(s, F.array(x.cast("double")))).otherwise(s))
    # both are computed once; as mere expressions they would be for each position anew
    return let(F.array_sort(F.array_distinct(xs)), lambda at: let(F.greatest((F.array_max(at) - F.array_min(at)) * 0.06, F.lit(12.0)), lambda tolerance: fold(at, tolerance)))


def nearest_column(anchors: Column, x: Column) -> Column:
    """Index from 0 of the anchor nearest to x; the first of two as near."""
    return F.array_min(F.transform(anchors, lambda a, i: F.struct(F.abs(a - x).alias("d"), i.alias("i"))))["i"]


def _median(values: Column) -> Column:
    """The median of an array of numbers, as F.median has it; null of none."""
    at = lambda v, i: F.get(v, F.floor(i).cast("int"))
    return let(F.sort_array(values), lambda v: 0.5 * at(v, (F.size(v) - 1) / 2) + 0.5 * at(v, F.size(v) / 2))


def measured_lines(words: DataFrame, page_widths: DataFrame | None = None) -> DataFrame:
    """A row for each line, with what its page and document are like: page_width (of ``page_widths``, else the words' own column, else 100 more than the words
    take up), body_height (of the whole document, so that headings agree across pages), char_width and word_width of the page, page_words, page_confidence.

    Words become lines first, and measures are taken of lines: words that are dealt by doc_id are made once and stay where they are, and all that follows keeps
    that partitioning."""
    own = [F.first("page_width").alias("page_width")] if page_widths is None and "page_width" in words.columns else []
    x = words.groupBy(*LINE).agg(
        F.sort_array(F.collect_list(F.struct("left", "pos", "text", "width"))).alias("words"),
        F.collect_list(F.when(F.length("text") > 1, F.col("width") / F.length("text"))).alias("_long"),
        F.min("left").alias("left"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.min("top").alias("top"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.sum("confidence").alias("_sure"),
        *own,
    )
    if page_widths is not None:
        x = x.join(page_widths.select(*PAGE, "page_width"), PAGE)
    x = x.withColumn("text", F.array_join("words.text", " "))
    x = x.withColumn("norm_height", (F.col("bottom") - F.col("top")) / extent_factor(F.col("text")))
    n = F.size("words")
    x = x.withColumn("body_height", F.percentile("norm_height", F.lit(0.5), n).over(Window.partitionBy("doc_id")))
    width = F.first("page_width") if "page_width" in x.columns else F.max("right") + 100
    held = [c for c in x.columns if c not in (*PAGE, "_long", "_sure", "page_width")]
    x = x.groupBy(*PAGE).agg(
        F.collect_list(F.struct(*held)).alias("l"),
        width.alias("page_width"),
        F.coalesce(_median(F.flatten(F.collect_list("_long"))), F.lit(8.0)).alias("char_width"),
        F.coalesce(_median(F.flatten(F.collect_list("words.width"))), F.lit(0.0)).alias("word_width"),
        F.sum(n).alias("page_words"),
        (F.sum("_sure") / F.sum(n)).alias("page_confidence"),
    )
    return x.select(*PAGE, "page_width", "char_width", "word_width", "page_words", "page_confidence", F.inline("l"))


def with_gutters(line: DataFrame) -> DataFrame:
    """Lines (with page_width) with gutter_start and gutter_end of their page, null but on pages with two columns: the widest stretch (the first
    of equals) in the middle half of the page that no line covers, of 3.5 % of the width at least, on a page of six lines or more.
    As no line covers it, none crosses it. Windows over the page alone: lines by left end, and how far those before reach."""
    w, on_page = F.col("page_width"), Window.partitionBy(*PAGE)
    clip = lambda c: F.greatest(F.lit(0), F.least(c, w - 1))
    lo, hi = F.floor(w * 0.25).cast("int"), F.floor(w * 0.75).cast("int")
    x = line.withColumns({"_l": clip(F.col("left")), "_r": clip(F.col("right")) + 1})
    reach = F.max("_r").over(on_page.orderBy("_l", "_r").rowsBetween(Window.unboundedPreceding, -1))
    stretch = lambda a, b: F.when(b > a, F.struct((b - a).alias("size"), (-a).alias("before")))
    x = x.withColumn("_gap", stretch(F.greatest(F.coalesce(reach, F.lit(0)), lo), F.least(F.col("_l"), hi)))
    best = F.greatest(F.max("_gap").over(on_page), stretch(F.greatest(F.max("_r").over(on_page), lo), hi))
    x = x.withColumns({"_n": F.count(F.lit(1)).over(on_page), "_best": best})
    there = (w > 0) & (F.col("_n") >= GUTTER_LINES) & (F.col("_best.size") >= w * F.lit(GUTTER_SHARE))
    start = F.when(there, -F.col("_best.before"))
    return x.withColumns({"gutter_start": start, "gutter_end": start + F.col("_best.size")}).drop("_l", "_r", "_gap", "_n", "_best")


def gutters(line: DataFrame, page_widths: DataFrame) -> DataFrame:
    """doc_id, page, gutter_start, gutter_end of pages with two columns, as ``with_gutters`` finds them."""
    return with_gutters(line.join(page_widths, PAGE)).where("gutter_start is not null").select(*PAGE, "gutter_start", "gutter_end").distinct()


def reading_order(line: DataFrame) -> DataFrame:
    """Lines (with gutter_start) with ``rank`` from 0 on each page: down the page, or where there is a gutter down the left
    column and then the right."""
    middle = (F.col("left") + F.col("right")) / 2
    x = line.withColumn("side", F.when(middle > F.col("gutter_start"), 1).otherwise(0))
    order = Window.partitionBy(*PAGE).orderBy("side", "top", "left", "block", "paragraph", "line")
    return x.withColumn("rank", F.row_number().over(order) - 1)


def _reach(line: DataFrame, counts: Column, allowance: Column) -> DataFrame:
    """Lines with ``threshold``, of their block: where a line must reach to have wrapped, as ``margins`` has it, measured on the lines that ``counts``
    names; null where a block has none. By rank within the block, so that no list of ends is kept."""
    x = line.withColumn("_counts", counts)
    alike = Window.partitionBy(*PAGE, "block", "_counts")
    ends = alike.orderBy("right")
    place, n = F.row_number().over(ends), F.count(F.lit(1)).over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumns({"_place": place, "_of": n})
    at = F.when(F.col("_counts") & (F.col("_place") == F.floor(F.col("_of") * 0.9) + 1), F.col("right"))
    return x.withColumn("threshold", F.max(at).over(Window.partitionBy(*PAGE, "block")) - allowance).drop("_counts", "_place", "_of")


def _goes_on(before: Column, line: dict[str, Column]) -> Column:
    """Whether a prose line continues the paragraph of the line ``before`` (block, bottom, right, threshold): same block, within
    1.2 body heights, and that line reached its margin."""
    near = (line["body_height"] <= 0) | (line["top"] - before["bottom"] <= line["body_height"] * 1.2)
    return (line["block"] == before["block"]) & near & F.coalesce(before["right"] >= before["threshold"], F.lit(True))


_GOES_ON = ("block", "top", "body_height")


def paragraphs(ordered: DataFrame) -> DataFrame:
    """Paragraphs of measured lines in reading order, all taken as prose: doc_id, page, paragraph, n_lines, text."""
    allowance = F.greatest(F.col("char_width") * CELL_GAP, F.col("word_width") * 1.3)
    x = _reach(ordered, F.lit(True), allowance)
    order = Window.partitionBy(*PAGE).orderBy("rank")
    before = F.lag(F.struct("block", "bottom", "right", "threshold")).over(order)
    x = x.withColumn("_before", before)
    opens = ~F.coalesce(_goes_on(F.col("_before"), {c: F.col(c) for c in _GOES_ON}), F.lit(False))
    x = x.withColumn("_opens", opens.cast("int")).withColumn("n", F.sum("_opens").over(order))
    out = x.groupBy(*PAGE, "n").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("t"), F.count(F.lit(1)).alias("n_lines"))
    return out.select(*PAGE, F.col("n").alias("paragraph"), "n_lines", join_lines(F.transform("t", lambda v: v["text"])).alias("text"))


def line_cells(words: Column, gap: Column) -> Column:
    """array<struct<x, text>> of a line's words by position: cells part where the space before a word is wider than ``gap``."""
    n = F.size(words)
    wide = lambda i: F.get(words, i)["left"] - F.get(words, i - 1)["left"] - F.get(words, i - 1)["width"] > gap
    cuts = F.when(n > 1, F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), wide)).otherwise(F.array().cast("array<int>"))
    cell = lambda s, e: F.struct(F.get(words, s)["left"].cast("double").alias("x"), F.array_join(F.transform(F.slice(words, s + 1, e - s), lambda w: w["text"]), " ").alias("text"))
    return let(cuts, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), c), F.concat(c, F.array(n)), cell))


def table_markdown(rows: Column) -> Column:
    """Rows of cells put into shared columns, as a Markdown table; null where that makes no table: fewer than two or more than ten
    columns, or nothing in the first row. Cells that fall into the same column are joined."""

    def row(cells: Column, anchors: Column) -> Column:
        placed = F.transform(cells, lambda c: F.struct(nearest_column(anchors, c["x"]).alias("k"), stripped(c["text"]).alias("text")))
        held = lambda p, k: F.array_join(F.transform(F.filter(p, lambda c: c["k"] == k), lambda c: c["text"]), " ")
        return let(placed, lambda p: F.transform(anchors, lambda _, k: F.replace(stripped(held(p, k)), F.lit("|"), F.lit("\\|"))))

    piped = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def shown(grid: Column, anchors: Column) -> Column:
        rule = piped(F.transform(anchors, lambda _: F.lit("---")))
        body = F.transform(grid, piped)
        text = let(body, lambda b: F.array_join(F.concat(F.slice(b, 1, 1), F.array(rule), F.slice(b, F.lit(2), F.size(b))), "\n"))
        return F.when(F.exists(F.get(grid, F.lit(0)), lambda c: c != ""), text)

    def laid(anchors: Column) -> Column:
        return F.when(F.size(anchors).between(2, TABLE_COLUMNS), let(F.transform(rows, lambda r: row(r, anchors)), lambda g: shown(g, anchors)))

    return let(column_anchors(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda c: c["x"])))), laid)


def with_tables(ordered: DataFrame) -> DataFrame:
    """Lines in reading order (with level) with in_run (part of a run of lines that look like a table), in_table (of one that could be laid out) and, on the
    first line of such, ``table``, its Markdown; with measures (margins are measured on it: prose, neither of a table nor a heading, as long as the page has any)
    and prose_width, the median width of the words of those lines. The lines of a page are gathered and folded, and come back from the same row, without a join."""
    x = ordered.withColumn("cells", line_cells(F.col("words"), F.col("char_width") * CELL_GAP))
    held = [c for c in x.columns if c not in (*PAGE, "rank")]
    x = x.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("rank", *held))).alias("l"))
    l = F.col("l")  # noqa: E741
    kept = ["rank", *[c for c in held if c != "cells"]]
    part = lambda start, end, run, table: F.struct(start.alias("start"), end.alias("end"), run.alias("run"), table.alias("table"))

    def parts(runs: Column) -> Column:
        """The runs, and the stretches before, between and after them."""
        table = lambda r: table_markdown(F.slice(l["cells"], r["start"] + 1, r["length"]))
        tables = F.transform(runs, lambda r: part(r["start"], r["start"] + r["length"], F.lit(True), table(r)))
        ends = F.transform(runs, lambda r: r["start"] + r["length"])
        between = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(runs["start"], F.array(F.size(l))), lambda a, z: part(a, z, F.lit(False), F.lit(None).cast("string")))
        return F.concat(tables, between)

    def labelled(p: Column) -> Column:
        line = lambda v, j: F.struct(*[v[c].alias(c) for c in kept], p["run"].alias("in_run"), p["table"].isNotNull().alias("in_table"), F.when(j == 0, p["table"]).alias("table"), (~p["run"] & v["level"].isNull()).alias("plain"))
        return F.transform(F.slice(l, p["start"] + 1, p["end"] - p["start"]), line)

    def with_width(lines_: Column) -> Column:
        prose = let(F.filter(lines_, lambda v: v["plain"]), lambda p: F.when(F.size(p) > 0, p).otherwise(lines_))
        return F.struct(lines_.alias("l"), F.exists(lines_, lambda v: v["plain"]).alias("any"), _median(F.flatten(F.transform(prose, lambda v: v["words"]["width"]))).alias("width"))

    runs = table_runs(F.transform(l["cells"], F.size))
    x = x.select(*PAGE, let(F.flatten(F.transform(let(runs, parts), labelled)), with_width).alias("p"))
    x = x.select(*PAGE, F.col("p.any").alias("_any"), F.coalesce("p.width", F.lit(0.0)).alias("prose_width"), F.inline("p.l"))
    return x.withColumn("measures", F.col("plain") | ~F.col("_any")).drop("plain", "_any")


def page_blocks(words: DataFrame, page_widths: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """doc_id, page, n, kind, text of each block of a page in reading order, and page_words, page_confidence: table, item, heading or prose. Lines
    are taken first by tables, then as list items, as headings, and else as prose, of which a line opens a paragraph after any other block or where it
    doesn't go on with the one before. Blank lines count for nothing; a page of them alone has one row without kind and text. ``parts`` is how many tasks the
    words are dealt to, that of a shuffle if not given.

    Labels, running sums and windows over one partitioning: words are shuffled once at most and lines once, and no more than the lines of a page are gathered into one value."""
    order = Window.partitionBy(*PAGE).orderBy("rank")
    x = reading_order(with_gutters(measured_lines(recognised(words), page_widths)))
    x = x.withColumn("text", stripped(F.col("text"))).withColumn("n_words", F.size("words"))
    x = with_tables(x.withColumn("level", heading_level(F.col("text"), F.col("n_words"), F.col("norm_height"), F.col("body_height")))).drop("words")
    # A stage of all of this has more generated classes than Spark keeps (spark.sql.codegen.cache.maxEntries, 100), and each task would compile them anew; so
    # lines, without their words, are dealt once more. Were the number that of the words' parts, Spark would leave that out.
    parts = parts or int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(parts // 2 + 1, "doc_id")
    x = _reach(x, F.col("measures"), F.greatest(F.col("char_width") * CELL_GAP, F.col("prose_width") * 1.3))
    item = list_item(F.col("text"))
    kind = F.when(F.col("table").isNotNull(), "table").when(F.col("in_table") | (F.col("text") == ""), F.lit(None)).when(item.isNotNull(), "item").when(F.col("level").isNotNull(), "heading").otherwise("prose")
    x = x.withColumn("kind", kind)
    shown = F.when(F.col("kind") == "table", F.col("table")).when(F.col("kind") == "item", item).when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).when(F.col("kind") == "prose", F.col("text"))
    x = x.withColumn("shown", shown)
    last = F.last(F.when(F.col("kind").isNotNull(), F.struct("kind", "block", "bottom", "right", "threshold")), ignorenulls=True)
    x = x.withColumn("_before", last.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    goes_on = (F.col("kind") == "prose") & (F.col("_before.kind") == "prose") & _goes_on(F.col("_before"), {c: F.col(c) for c in _GOES_ON})
    opens = F.col("kind").isNotNull() & ~F.coalesce(goes_on, F.lit(False))
    x = x.withColumn("_opens", opens.cast("int")).withColumn("n", F.sum("_opens").over(order))
    lines_ = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("rank", "shown"))))
    out = x.groupBy(*PAGE, "n").agg(F.max("kind").alias("kind"), lines_.alias("l"), F.first("page_words").alias("page_words"), F.first("page_confidence").alias("page_confidence"))
    texts = F.transform("l", lambda v: v["shown"])
    return out.select(*PAGE, "n", "kind", F.when(F.col("kind") == "prose", join_lines(texts)).otherwise(F.get(texts, F.lit(0))).alias("text"), "page_words", "page_confidence")


def documents(pages: DataFrame, low: float = 70.0) -> DataFrame:
    """Pages put together: markdown of those that aren't blank, in order; confidence weighted by words,
    pages of unknown confidence (-1) or without words left out, -1 where none counts; tally and warnings."""
    counts = (F.col("confidence") >= 0) & (F.col("word_count") > 0)
    out = pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.trim("markdown") != "", F.struct("page", "markdown")))), lambda p: p["markdown"]), "\n\n").alias("markdown"),
        (F.sum(F.when(counts, F.col("confidence") * F.col("word_count"))) / F.sum(F.when(counts, F.col("word_count")))).alias("confidence"),
        F.sum("word_count").alias("word_count"),
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.trim("markdown") == "").alias("empty_pages"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "warnings"))), lambda p: p["warnings"])).alias("noted"),
    )
    out = out.withColumn("confidence", F.coalesce("confidence", F.lit(-1.0)))
    low_ = F.when((F.col("confidence") >= 0) & (F.col("confidence") < low), F.array(F.lit("Recognition confidence is low; please check the text against the original.")))
    empty = F.when(F.col("empty_pages") > 0, F.array(F.concat(F.col("empty_pages").cast("string"), F.lit(" page(s) held no readable text."))))
    none = F.array().cast("array<string>")
    return out.withColumn("warnings", F.array_distinct(F.concat("noted", F.coalesce(empty, none), F.coalesce(low_, none)))).drop("noted")


def reconstruct(words: DataFrame, page_widths: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """doc_id, page, markdown, word_count, confidence, warnings of every page: its blocks in order, an empty line between them."""
    blocks = page_blocks(words, page_widths, parts)
    listed = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("n", "text"))))
    out = blocks.groupBy(*PAGE).agg(listed.alias("b"), F.first("page_words").alias("word_count"), F.first("page_confidence").alias("confidence"))
    warned = F.when(F.size("b") == 0, F.array(F.lit("No readable text was found on this page."))).otherwise(F.array().cast("array<string>"))
    return out.select(*PAGE, F.array_join(F.transform("b", lambda v: v["text"]), "\n\n").alias("markdown"), "word_count", "confidence", warned.alias("warnings"))
