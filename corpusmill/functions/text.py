"""Column functions over text: links and paths, sections, windows, tolerant JSON, signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a DOI looks like, and what may trail it.
DOI = r"10\.\d{4,9}/[^\s?#\"'<>]+"
DOI_TRAIL = r"[).,;'\"]+$"
#: Characters of a token, by calibration.
CHARS_PER_TOKEN = 3.58
#: Lines that begin a section.
HEADINGS = (
    "abstract", "introduction", "background", "methods", "materials and methods", "results", "discussion",
    "conclusion", "conclusions", "references", "bibliography", "acknowledgements", "acknowledgments",
)
#: Sections that carry evidence, best first.
EVIDENCE = (
    "_preamble", "abstract", "introduction", "background", "results", "discussion", "conclusion", "conclusions",
    "methods", "materials and methods",
)
#: A line that is a heading, numbered or not.
HEADING = r"(?i)^\s*(?:\d+\.?\s*)?(" + "|".join(HEADINGS) + r")\s*:?\s*$"
#: Where lines end.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Starts of reference entries, surnames and years.
ENTRY = r"^[A-Z][A-Za-zÀ-ÿ'’-]+(?:\s*,\s*[A-Z]\s*\.|\s+[A-Z]{1,4}\b)"
SURNAME = r"^\s*([A-Z][A-Za-zÀ-ÿ'’.-]*)"
YEAR = r"\b(1[89]\d\d|20\d\d)\b"
CITED_YEAR = r"\(\d{4}[a-z]?\)"
#: Words of names that do not tell them apart.
NAME_STOP = ("code", "codes", "the", "a", "an", "of", "organic", "biological")


def nullif_blank(c: Column) -> Column:
    return F.when(c != "", c)


def doi(url: Column) -> Column:
    """the DOI in a link, without punctuation behind it; null if there is none."""
    return nullif_blank(F.regexp_replace(F.regexp_extract(url, DOI, 0), DOI_TRAIL, ""))


def url_slug(url: Column) -> Column:
    """a link as a file name of at most 150 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit(150))


def output_path(url: Column, folder: str) -> Column:
    """where the paper of a link is kept: by its DOI, else by the link."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.coalesce(F.replace(doi(url), F.lit("/"), F.lit("_")), url_slug(url)), F.lit(".pdf"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shortened(s: Column, n: int = 40) -> Column:
    """at most ``n`` characters and an ellipsis where one would not do with one more."""
    return F.when(F.length(s) > n + 1, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def estimate_tokens(text: Column) -> Column:
    """F5."""
    return F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def self_reference(path: Column, hosts: list[str]) -> Column:
    """A path that names one of the corpus's own hosts."""
    found = F.lit(False)
    for host in hosts:
        found = found | F.lower(path).contains(host.lower())
    return found


def looks_like_pdf(head: Column, content_type: Column) -> Column:
    """by its first bytes or its declared type."""
    return F.coalesce(F.substring(head, 1, 4) == F.lit(b"%PDF"), F.lit(False)) | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))


def looks_like_html(head: Column, content_type: Column) -> Column:
    """by its declared type, or by how its first 256 bytes begin or a head among them."""
    start = F.lower(F.regexp_replace(F.decode(F.substring(head, 1, 256), "iso-8859-1"), r"^[ \t\n\r\x0b\f]+", ""))
    return F.coalesce(start.startswith("<!doctype") | start.startswith("<html") | start.contains("<head"), F.lit(False)) | F.coalesce(F.lower(content_type).contains("html"), F.lit(False))


def citation_link(html: Column) -> Column:
    """F3 without the base: content of the first meta tag that names a paper's PDF; null if there is none."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: t.rlike(r"(?i)name\s*=\s*['\"]citation_pdf_url['\"]") & t.rlike(r"(?i)content\s*=\s*['\"][^'\"]+['\"]"))
    return F.regexp_extract(F.get(named, F.lit(0)), r"(?i)content\s*=\s*['\"]([^'\"]+)['\"]", 1)


@F.pandas_udf(T.StringType())
def resolved(link: pd.Series, base: pd.Series) -> pd.Series:
    """a link relative to the page that holds it."""
    from urllib.parse import urljoin

    return pd.Series([None if u is None else urljoin(b, u) if b else u for u, b in zip(link, base, strict=True)])


def first_pdf_link(links: Column) -> Column:
    """URL of the first link of ``array<struct<content_type, url>>`` declared as PDF."""
    return F.get(F.filter(links, lambda x: x["content_type"] == "application/pdf"), F.lit(0))["url"]


def open_urls(best: Column, others: Column) -> Column:
    """direct PDF links before landing pages, the best location first, each once."""
    places = F.filter(F.concat(F.array(best), F.coalesce(others, F.array().cast("array<struct<url_for_pdf:string,url:string>>"))), lambda x: x.isNotNull())
    return F.array_distinct(F.filter(F.concat(F.transform(places, lambda x: x["url_for_pdf"]), F.transform(places, lambda x: x["url"])), lambda u: u.isNotNull() & (u != "")))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows that overlap; one window if all fits, and the last one reaches the end."""
    step = max(1, size - overlap)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)


def token_windows(tokens: Column, size: int = 8192, overlap: int = 4096) -> Column:
    """Windows of token arrays; an empty array has no window.

    The array is bound by a transform over an array of one, else an expression for it would be made anew for each window.
    """

    def windows(t: Column) -> Column:
        n = F.size(t)
        return F.when(n > 0, F.transform(window_starts(n, size, overlap), lambda s: F.slice(t, s + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))

    return F.get(F.transform(F.array(tokens), windows), F.lit(0))


def prose_windows(text: Column, size: int = 12000, overlap: int = 1500) -> Column:
    """Windows of characters; blank text has none."""
    windows = F.transform(window_starts(F.length(text), size, overlap), lambda s: F.substring(text, s + 1, F.lit(size)))
    return F.when(F.trim(text) != "", windows).otherwise(F.array().cast("array<string>"))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, section, body)``; text before the first heading is ``_preamble``, a repeated heading adds to its section.

    Lines are folded inside the row, so a document is never spread over tasks.
    """
    lines = F.split(F.col(text), LINE_END, -1)
    start = F.expr("cast(named_struct('s', '_preamble', 'l', array()) as struct<s:string,l:array<struct<s:string,line:string>>>)")
    step = lambda acc, line: F.struct(
        F.coalesce(nullif_blank(F.lower(F.regexp_extract(line, HEADING, 1))), acc["s"]).alias("s"),
        F.concat(acc["l"], F.array(F.struct(F.coalesce(nullif_blank(F.lower(F.regexp_extract(line, HEADING, 1))), acc["s"]).alias("s"), line.alias("line")))).alias("l"),
    )
    tagged = df.select(key, F.aggregate(lines, start, step, lambda acc: acc["l"]).alias("__l"))
    names = F.array_union(F.array(F.lit("_preamble")), F.transform("__l", lambda x: x["s"]))
    rows = tagged.select(key, "__l", F.explode(names).alias("section"))
    body = F.regexp_replace(F.array_join(F.transform(F.filter("__l", lambda x: x["s"] == F.col("section")), lambda x: x["line"]), "\n"), r"(?U)^\s+|\s+$", "")
    return rows.select(key, "section", body.alias("body")).where((F.col("body") != "") | (F.col("section") == "_preamble"))


def abstracts(df: DataFrame, key: str, text: str, max_chars: int = 4000) -> DataFrame:
    """the abstract, else the preamble, cut to ``max_chars``."""
    parts = sections(df, key, text).where(F.col("section").isin("abstract", "_preamble")).groupBy(key).agg(
        F.max(F.when(F.col("section") == "abstract", F.col("body"))).alias("a"), F.max(F.when(F.col("section") == "_preamble", F.col("body"))).alias("p")
    )
    return parts.select(key, F.left(F.coalesce(nullif_blank(F.col("a")), F.col("p"), F.lit("")), F.lit(max_chars)).alias("abstract"))


def within_budget(df: DataFrame, key: str, text: str, max_tokens: int) -> DataFrame:
    """``(key, text)``, whole if it fits; else evidence sections in their order, passing over those that overflow;
    else cut to the budget."""
    budget = int(max_tokens * CHARS_PER_TOKEN)
    bodies = sections(df, key, text).where(F.col("section").isin(*EVIDENCE) & (F.col("body") != ""))
    order = F.array_position(F.array(*[F.lit(s) for s in EVIDENCE]), F.col("section"))
    listed = bodies.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "body"))).alias("b"))
    joined = df.select(key, F.col(text).alias("__t")).join(listed, key, "left")
    start = F.expr("cast(named_struct('used', 0, 'out', '') as struct<used:int,out:string>)")

    def add(acc: Column, x: Column) -> Column:
        block = F.when(acc["used"] == 0, x["body"]).otherwise(F.concat(F.lit("\n"), x["body"]))
        fits = acc["used"] + F.length(block) <= budget
        return F.struct(F.when(fits, acc["used"] + F.length(block)).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    kept = F.trim(F.aggregate("b", start, add, lambda acc: acc["out"]))
    chosen = F.when((kept == "") | kept.isNull() | (estimate_tokens(kept) > max_tokens), F.left("__t", F.lit(budget))).otherwise(kept)
    return joined.select(key, F.when(estimate_tokens(F.col("__t")) <= max_tokens, F.col("__t")).otherwise(chosen).alias(text))


def signature(name: Column) -> Column:
    """``struct(surname, year)`` of a citation; null if either is missing."""
    surname = F.regexp_replace(F.lower(F.regexp_extract(name, SURNAME, 1)), r"\.+$", "")
    year = F.regexp_extract(name, YEAR, 1)
    return F.when((surname != "") & (year != ""), F.struct(surname.alias("surname"), year.alias("year")))


def reference_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, entry_no, entry)``; an entry begins at a surname with initials and goes on over the lines that follow."""
    lines = df.select(key, F.posexplode(F.split(text, LINE_END, -1)).alias("no", "line")).withColumn("line", F.trim("line"))
    run = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("entry_no", F.sum(F.col("line").rlike(ENTRY).cast("int")).over(run)).where("entry_no > 0")
    gathered = numbered.groupBy(key, "entry_no").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    return gathered.select(key, "entry_no", F.array_join(F.col("l.line"), " ").alias("entry"))


def content_tokens(name: Column) -> Column:
    """Sorted distinct words of a name that tell it apart."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*NAME_STOP))))


def citation_count(text: Column) -> Column:
    """Years in parentheses."""
    return F.regexp_count(text, F.lit(CITED_YEAR))


def json_object(reply: Column) -> Column:
    """F16: the first fenced object of a reply, else what lies between its first and last brace; null if there is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.coalesce(nullif_blank(fenced), nullif_blank(braced))


def prompt_hash(template: Column) -> Column:
    """F27."""
    return F.sha2(template, 256)


def query_text(task: Column, text: Column) -> Column:
    """F25."""
    return F.concat(F.lit("Instruct: "), task, F.lit("\nQuery: "), text)


def prompt(parts: list[Column]) -> Column:
    """parts of a prompt in order, the passage first among them so that prompts share a prefix; nulls are left out."""
    return F.concat_ws("\n\n", *parts)


def signed_number(x: Column, digits: int = 3) -> Column:
    """with its sign; n/a for null and NaN."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.format_string(f"%+.{digits}f", x)).otherwise("n/a")
