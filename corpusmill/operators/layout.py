"""A reference table read from page layout: characters and links as long tables.

``chars(page, x0, x1, top, bottom, text)`` and ``links(page, x0, x1, top, bottom, uri)``. Bands are made within a page;
only the code that a page hands on is carried over pages, in a window over one row a page of a document.

Characters and links are often exploded from few stored rows. Spark estimates their size by the file that they come from
and may broadcast them, so the joins on pages are merge joins by a hint. So are those on codes, which are as many as rows of
the table and, packed, look smaller than they are in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation_count

#: Columns of the table by left edge, the footer, and how far a link may sit above its row's number.
COLUMNS = {"number": (35, 92), "code_name": (92, 202), "descriptive": (202, 344), "citations": (344, 850)}
FOOTER, SLACK = 540, 5


def in_column(chars: DataFrame, column: str) -> DataFrame:
    """P10."""
    low, high = COLUMNS[column]
    return chars.where((F.col("x0") >= low) & (F.col("x0") < high) & (F.col("top") < FOOTER))


def citation_links(links: DataFrame) -> DataFrame:
    """P9."""
    return links.where(F.col("uri").startswith("http") & (F.col("x0") >= COLUMNS["citations"][0]))


def line(top: str | Column = "top") -> Column:
    return F.bround(top).cast("int")


def reading_text(chars: DataFrame, keys: list[str]) -> DataFrame:
    """characters by visual line, then from left to right, lines joined by a space."""
    lines = chars.groupBy(*keys, line().alias("__l")).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("c"))
    lines = lines.withColumn("t", F.trim(F.array_join(F.col("c.text"), ""))).where("t <> ''")
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__l", "t"))).alias("l")).select(*keys, F.array_join(F.col("l.t"), " ").alias("text"))


def anchors(chars: DataFrame, doc: list[str]) -> DataFrame:
    """``(doc.., page, top, code_number)``: lines of the number column that are a number."""
    rows = in_column(chars, "number").groupBy(*doc, "page", line().alias("top")).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("c"))
    rows = rows.withColumn("t", F.trim(F.array_join(F.col("c.text"), ""))).where(F.col("t").rlike(r"^\d+$"))
    return rows.select(*doc, "page", "top", F.col("t").cast("int").alias("code_number"))


def bands(chars: DataFrame, doc: list[str]) -> DataFrame:
    """``(doc.., page, top0, top1, code_number)``: half-open bands of a page, from one anchor to the next;
    what stands above a page's first anchor belongs to the last code before it."""
    found = anchors(chars, doc)
    below = F.lead("top").over(Window.partitionBy(*doc, "page").orderBy("top"))
    own = found.select(*doc, "page", (F.col("top") - SLACK).alias("top0"), F.coalesce(below - SLACK, F.lit(FOOTER)).alias("top1"), "code_number")
    pages = chars.select(*doc, "page").distinct().hint("merge").join(found.groupBy(*doc, "page").agg(F.min("top").alias("first"), F.max_by("code_number", "top").alias("last")), [*doc, "page"], "left")
    before = Window.partitionBy(*doc).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.withColumn("code_number", F.last("last", ignorenulls=True).over(before)).where("code_number is not null")
    carried = carried.select(*doc, "page", F.lit(0).alias("top0"), F.coalesce(F.col("first") - SLACK, F.lit(FOOTER)).alias("top1"), "code_number").where("top1 > top0")
    return own.unionByName(carried)


def banded(rows: DataFrame, found: DataFrame, doc: list[str]) -> DataFrame:
    """Rows with the code of their band; bands of a page do not overlap, so rows are not multiplied."""
    b = found.select(*doc, "page", "top0", "top1", "code_number")
    return rows.hint("merge").join(b, [*doc, "page"]).where((line() >= F.col("top0")) & (line() < F.col("top1"))).drop("top0", "top1")


def link_runs(links: DataFrame, keys: list[str]) -> DataFrame:
    """Links with ``run``: neighbours in reading order on one page with one target are one reference."""
    order = Window.partitionBy(*keys).orderBy("page", line(), "x0")
    new = ~(F.col("uri").eqNullSafe(F.lag("uri").over(order)) & F.col("page").eqNullSafe(F.lag("page").over(order)))
    return links.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def covered(chars: DataFrame, rects: DataFrame, keys: list[str], margin: float = 2) -> DataFrame:
    """Characters whose centre lies in a rectangle of a run, once for each run; an equi-join on page and code first."""
    c = chars.withColumn("__x", (F.col("x0") + F.col("x1")) / 2).withColumn("__y", (F.col("top") + F.col("bottom")) / 2).withColumn("__c", F.monotonically_increasing_id())
    r = rects.select(*keys, "page", "run", "uri", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("top").alias("rt"), F.col("bottom").alias("rb"))
    hit = c.hint("merge").join(r, [*keys, "page"]).where(F.col("__x").between(F.col("rx0") - margin, F.col("rx1") + margin) & F.col("__y").between(F.col("rt") - margin, F.col("rb") + margin))
    names = [n for n in chars.columns if n not in (*keys, "page")]
    return hit.groupBy(*keys, "page", "run", "uri", "__c").agg(*[F.first(n).alias(n) for n in names])


def extract_references(chars: DataFrame, links: DataFrame, doc: list[str]) -> DataFrame:
    """``(doc.., code_number, code_name, paper_name, url)``.

    A code without links keeps its citation text with an empty link; a link without text is left out. A code's name is
    that of its first band with one.
    """
    found = bands(chars, doc)
    keys = [*doc, "code_number"]
    inside = banded(chars, found, doc)
    names = reading_text(in_column(inside, "code_name"), [*keys, "page"])
    names = names.groupBy(*keys).agg(F.min_by("text", "page").alias("code_name"))
    cited = in_column(inside, "citations")
    runs = link_runs(banded(citation_links(links), found, doc), keys)
    linked = reading_text(covered(cited, runs, keys), [*keys, "run", "uri"]).select(*keys, F.col("text").alias("paper_name"), F.col("uri").alias("url"))
    bare = reading_text(cited, keys).hint("merge").join(runs.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("text").alias("paper_name"), F.lit("").alias("url"))
    out = linked.unionByName(bare).hint("merge").join(names, keys, "left")
    return out.select(*keys, F.coalesce("code_name", F.lit("")).alias("code_name"), "paper_name", "url")


def citation_mismatches(chars: DataFrame, links: DataFrame, doc: list[str]) -> DataFrame:
    """Codes whose citation texts name another number of years than there are links."""
    found, keys = bands(chars, doc), [*doc, "code_number"]
    expected = reading_text(in_column(banded(chars, found, doc), "citations"), keys).select(*keys, citation_count(F.col("text")).alias("expected"))
    runs = link_runs(banded(citation_links(links), found, doc), keys).groupBy(*keys).agg(F.count_distinct("run").alias("found"))
    both = expected.hint("merge").join(runs, keys, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where("expected <> found")
