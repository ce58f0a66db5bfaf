"""Line-first quality rules, in DataFrame functions only.

Every line is judged on its own by three rules (punctuation, navigation, boilerplate); lines that fail are
removed, and a document that loses too much of its text is rejected. Counts that need the order of words
(repeated three-word windows) are made inside the row: windows are hashed, sorted with their positions, and
neighbours with equal hashes mark their words. Work is O(n log n) in a row's words and nothing is shuffled,
so a hot source or a group of copies cannot gather anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: What stands between words.
BLANK = " \t\n\x0b\x0c\r"
#: How a line of prose ends.
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*$"""
#: Marks between the entries of menus and tables.
SEPARATORS = r"[|›•·>]"
#: Marks that shouting and symbol noise put at the ends of words, two or more at a time.
MARK_RUN = r"[!?#*$%&<>^~=_+]{2,}"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "enable javascript", "click here", "subscribe now", "lorem ipsum", "powered by", "copyright", "©",
)


#: Columns that the rules add.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the array, first occurrences included.

    Windows are told apart by XXH64; two different windows of one row agree by chance with odds of n^2 / 2^65.
    """
    starts = F.size(words) - (size - 1)
    keyed = F.transform(
        F.slice(words, 1, F.greatest(starts, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]).alias("h"), i.alias("p")),
    )
    return F.sort_array(keyed)


def covered(ranked: Column, size: int = 3) -> Column:
    """From the sorted ``(h, p)`` pairs: the sorted start positions of windows that have an equal neighbour."""
    hit = F.filter(ranked, lambda x, i: F.coalesce(F.get(ranked, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False)))
    return F.sort_array(F.transform(hit, lambda x: x["p"]))


def covered_words(starts: Column, size: int = 3) -> Column:
    gaps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(size)), F.lit(size)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def has_boilerplate(text: Column) -> Column:
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | text.contains(phrase)
    return out


def line_fails(line: Column, furnished: Column | bool = True, max_mark_share: float = 0.3, max_separator_share: float = 0.15) -> Column:
    """True for a line that breaks a rule; ``line`` holds a word.

    Punctuation: a line has to end as a sentence does, and few of its words may come with runs of marks.
    Navigation: marks between entries make up no more than ``max_separator_share`` of its words.
    Boilerplate: no phrase of page furniture; looked for only where ``furnished``.
    """
    n = F.regexp_count(line, F.lit(WORD))
    open_end = ~F.right(F.rtrim(line, F.lit(BLANK)), F.lit(4)).rlike(SENTENCE_END)
    shouted = F.regexp_count(line, F.lit(MARK_RUN)) > max_mark_share * n
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) > max_separator_share * n
    return open_end | shouted | navigation | (F.lit(furnished) & has_boilerplate(F.lower(line)))


def quality_rules(docs: DataFrame, text: str = "text", max_loss: float = 0.5, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``clean_text`` and ``kept``; these replace columns of the same names.

    A null text counts as empty: all counts 0, base_failed true, kept false. An empty table gives an empty one.
    ``clean_text`` has the lines that pass, joined by newlines. ``kept`` is false where ``base_failed`` is true or
    where the failing lines hold more than ``max_loss`` of the characters in words. Repeated rows are judged alike.
    """
    size = 3
    row, t = F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit(""))
    out = docs.select(row, t.alias("t")).withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    out = out.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumn("s", repeated_window_words(F.col("w"), size))
    out = out.withColumn("s", covered(F.col("s"), size))
    # outside the lambda, so that the test on the whole text is made once a row and not once a line
    out = out.withColumn("f", has_boilerplate(F.lower("t")))
    out = out.withColumn("bad", F.when(F.col("f"), F.filter("l", lambda x: line_fails(x))).otherwise(F.filter("l", lambda x: line_fails(x, False))))
    out = out.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        "n_repeat_words": covered_words(F.col("s"), size),
        "lost": F.length(F.regexp_replace(F.array_join("bad", ""), r"[\x20\x09-\x0D]+", "")).cast("long"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > F.lit(int(100 * max_repeat)) * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_loss * F.col("word_chars")))
    out = out.withColumn("clean_text", F.array_join(F.filter(F.split("t", "\n"), lambda x: ~x.rlike(WORD) | ~line_fails(x)), "\n"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in MADE], *MADE)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op1; the cleaned text is pruned from the plan."""
    return quality_rules(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
