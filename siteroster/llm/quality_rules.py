"""Quality rules: per-document counts, and lines that many documents of one host share.

Lines are normalised (A-Z lower-cased, white space squeezed) and hashed. A line
is boilerplate of a host if it stands in at least ``min_docs`` documents of that
host and in more than ``share`` of them, unless all of those documents are exact
copies of one text: copies are the work of deduplication, not boilerplate.
Boilerplate lines are removed; a document left with fewer than ``min_left`` of
its words is depleted and rejected, as is one that fails the base rules.

Defined results: a null text has no words and fails the base rules; a null host
is a host of its own; repeated rows (same id, host and text) count like copies
and get the same verdict; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.llm.words import SPACE_CHARS, ascii_lower, lines, text_or_empty, words
from siteroster.session import materialize

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def base_counts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, source``, the text's hash, and the counts of the base rules.

    With ``carry``, ``row`` holds the whole input row.

    A window of eight words is a 64-bit hash of its words' hashes. Only texts
    with a repeated window sort theirs; a run of repeated windows covers its
    words once, so the count is a sum over the gaps between their starts.
    """
    text, row = F.col("text"), ["row"] if carry else []
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    counted = docs.select("doc_id", "source", text_or_empty().alias("text"), *whole).select(
        "doc_id", "source", *row, F.xxhash64("text").alias("text_key"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines(text).alias("lines"),
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("hashes"),
    )
    n = F.size("hashes")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
    counted = counted.select(
        "doc_id", "source", *row, "text_key", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.withColumn("ordered", ordered).drop("windows")
    starts = F.array_sort(F.filter(F.transform(
        "ordered",
        lambda e, k: F.when((e.h == F.get("ordered", k - 1).h) | (e.h == F.get("ordered", k + 1).h), e.i)),
        lambda i: i.isNotNull()))
    counted = counted.withColumn("starts", starts).drop("ordered")
    covered = F.aggregate(
        F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.coalesce(b - a, F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, gap: total + F.least(gap, F.lit(WINDOW)))
    counted = counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")
    # through a generator no later filter moves down to repeat the steps above in its condition
    return counted.select(F.explode(F.array(F.struct("*"))).alias("counts")).select("counts.*") if carry else counted


def _with_normal_lines(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The ``columns`` of ``docs`` and ``all``: the lines of the text that hold a word, white space squeezed, A-Z lower-cased.

    White space is brought down to single spaces for the whole text at once, by plain
    replacements where they do: patterns and translations cost many times as much a
    character. Steps are columns of their own, as each is used more than once.
    """
    spaced = text_or_empty()
    for c in SPACE_CHARS:
        if c not in " \n":
            spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    rows = docs.withColumn("all", F.struct(F.struct(*columns).alias("row"), spaced.alias("text"))).select("all.row", "all.text")
    text = F.col("text")
    rows = rows.select("row", F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text).alias("text"))
    # without other characters than ASCII both ways of lower-casing agree
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    lines = F.filter(F.transform(F.split(lower, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")
    return rows.select("row.*", lines.alias("all"))


def _text_key() -> Column:
    return F.xxhash64(text_or_empty()).alias("text_key")


def boilerplate_lines(docs: DataFrame, min_docs: int, share: float, by_text: bool = False) -> DataFrame:
    """``source, line``: hashes of lines over the limits, counted over all documents of each host.

    With ``by_text`` the different texts of a host are counted in place of its documents.
    """
    hashes = F.array_distinct(F.transform("all", lambda line: F.xxhash64(line)))
    # the text's own values come first: beside the generator they would be worked out for every line
    counted = _with_normal_lines(docs, "source", _text_key()).select("source", "text_key", hashes.alias("all"))
    # an inner explode would have the optimizer test each array's size, and work it out twice
    counted = counted.select("source", "text_key", F.explode_outer("all").alias("line")).where("line is not null")
    if by_text:
        counted = counted.distinct()
        docs = docs.select("source", _text_key()).distinct()
    found = counted.groupBy("source", "line").agg(
        F.count(F.lit(1)).alias("n"), F.min("text_key").alias("least"), F.max("text_key").alias("most"))
    found = found.where((F.col("n") >= min_docs) & (F.col("least") != F.col("most")))
    hosts = docs.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n_host"))
    return found.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(
        F.col("n") > share * F.col("n_host")).select("source", "line")


def _line_words(docs: DataFrame) -> DataFrame:
    """A row per line of each document, with the words of that line; no row carries the other lines."""
    place = F.transform("all", lambda line: F.struct(
        F.xxhash64(line).alias("line"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("line_words")))
    each = _with_normal_lines(docs, "doc_id", "source", _text_key()).select(
        "doc_id", "source", "text_key", place.alias("all"))
    # lines hold all words of a text
    each = each.withColumn("text_words", F.aggregate("all", F.lit(0), lambda n, line: n + line["line_words"]))
    each = each.select("doc_id", "source", "text_key", "text_words", F.posexplode_outer("all").alias("place", "value"))
    return each.where("value is not null").select("doc_id", "source", "text_key", "text_words", "place", "value.line", "value.line_words")


def removed_words(docs: DataFrame, min_docs: int, share: float, by_text: bool = False) -> DataFrame:
    """``r_doc, r_source, r_key, text_words, removed_words`` of the documents that hold boilerplate lines."""
    limits = boilerplate_lines(docs, min_docs, share, by_text).select(
        F.col("source").alias("b_source"), F.col("line").alias("b_line"))
    hits = _line_words(docs).join(
        limits, (F.col("line") == F.col("b_line")) & F.col("source").eqNullSafe(F.col("b_source")), "left_semi")
    # repeated rows hold the same lines at the same places
    once = hits.groupBy("doc_id", "source", "text_key", "text_words", "place").agg(F.max("line_words").alias("line_words"))
    return once.groupBy(
        F.col("doc_id").alias("r_doc"), F.col("source").alias("r_source"), F.col("text_key").alias("r_key"), "text_words",
    ).agg(F.sum("line_words").alias("removed_words"))


def _same_document():
    return ((F.col("text_key") == F.col("r_key")) & F.col("doc_id").eqNullSafe(F.col("r_doc"))
            & F.col("source").eqNullSafe(F.col("r_source")))


def _base_failed(min_words: int, max_repeat_percent: int):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def quality_rules(
    docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30,
    min_docs: int = 10, share: float = 0.1, min_left: float = 0.3,
) -> DataFrame:
    """Counts, ``base_failed``, ``removed_words`` and ``kept`` for every row of ``doc_id, text, source``."""
    base = base_counts(docs).withColumn("base_failed", _base_failed(min_words, max_repeat_percent))
    joined = base.join(removed_words(docs, min_docs, share), _same_document(), "left")
    left = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(F.col("removed_words"), F.lit(0)).cast("long").alias("removed_words"),
        (~F.col("base_failed") & (left >= min_left * F.col("n_words"))).alias("kept"))


def keep_good(
    docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30,
    min_docs: int = 10, share: float = 0.1, min_left: float = 0.3,
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Texts are only filtered where they are read: the depleted documents, few in
    all but odd corpora, are a table of keys whose size the join knows. Lines are
    counted by different texts, so copies and one near copy of them do not make
    their text boilerplate before deduplication can keep one.
    """
    depleted = removed_words(docs, min_docs, share, by_text=True).where(
        F.col("text_words") - F.col("removed_words") < min_left * F.col("text_words"))
    depleted = materialize(depleted.select("r_doc", "r_source", "r_key"), "depleted")
    base = base_counts(docs, carry=True).where(~_base_failed(min_words, max_repeat_percent))
    return base.join(depleted, _same_document(), "left_anti").select("row.*")
