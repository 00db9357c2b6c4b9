"""Line dedup: lines that several documents hold stay in the first of them alone.

Lines are keyed by two 64-bit hashes of their normalised form. Rows of ``key, share,
document, position`` are range-partitioned by key and share and sorted by document and
position within (the share is one of ``SHARES`` of a document's hash, so a line in a
third of all documents is dealt over as many groups). Each sorted run streams its first
occurrence forward; every row of a later document is dropped there. What is left, at
most one document of a key and share, runs through a second range partitioning by key
alone, whose groups are thus bounded. Texts never move with the lines: the dropped
positions come back as one bitmap a document, compressed to the 64-line words in which
a line goes, and the texts are cut where they are read.

Defined results: a null or empty text is one empty line; a document is an id, so equal
rows, or rows of one id with different texts, never drop each other's lines and each get
a result; rows with a null id are one document that comes after all others; keys shorter
than ``least`` code points stay everywhere; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteroster.llm.words import SPACE_CHARS, ascii_lower, text_or_empty
from siteroster.session import materialize

#: Groups a key's documents are dealt to in the first pass, and lines of a bitmap's word.
SHARES, WORD_LINES = 256, 64


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE_CHARS)))


def _text_keys() -> list[Column]:
    """128 bits of a text; with the id they name a row."""
    return [F.xxhash64(text_or_empty()).alias("t1"), F.xxhash64(F.lit(1), text_or_empty()).alias("t2")]


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, t1, t2, position, k1, k2, share`` of every line with a key of ``least`` code points or more."""
    # the text's own hashes come first: beside the generator they would be worked out for every line
    each = docs.select("doc_id", *_text_keys(), split_lines(text_or_empty()).alias("lines")).select(
        "doc_id", "t1", "t2", F.posexplode("lines").alias("position", "line"))
    keyed = each.select("doc_id", "t1", "t2", "position", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select(
        "doc_id", "t1", "t2", "position", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int").alias("share"))


def _first_of(table: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``first``: whether the row is of the first document of its group, streamed along the sorted run."""
    run = Window.partitionBy(*group).orderBy(F.col("doc_id").asc_nulls_last(), "position")
    return table.repartitionByRange(*group).withColumn(
        "first", F.col("doc_id").eqNullSafe(F.first("doc_id").over(run)))


def dropped_lines(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, t1, t2, position`` of the lines that an earlier document holds."""
    # written first: finding a range partitioning's bounds reads its input once more
    rows = materialize(line_rows(docs, least), "line-keys")
    found = materialize(_first_of(rows, ["k1", "k2", "share"]), "line-firsts")
    again = _first_of(found.where("first").drop("first", "share"), ["k1", "k2"])
    place = ["doc_id", "t1", "t2", "position"]
    return found.where("not first").select(place).union(again.where("not first").select(place))


def drop_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id, t1, t2, n_dropped, words``: per row with dropped lines, the sorted words ``(word, bits)`` that are not empty.

    Bit i of word w stands for line 64 * w + i. Rows with equal id and text share one bitmap.
    """
    words = dropped_lines(docs, least).groupBy(
        "doc_id", "t1", "t2", F.floor(F.col("position") / WORD_LINES).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, position % {WORD_LINES})")).alias("bits"))
    return words.groupBy("doc_id", "t1", "t2").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _dropped_flags(words: Column) -> Column:
    """Characters 0 and 1 from the first line to the last dropped one."""
    def piece(word: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(words, i - 1)["word"])
        gap = F.repeat(F.lit("0"), ((word["word"] - before - 1) * WORD_LINES))
        return F.concat(gap, F.reverse(F.lpad(F.bin(word["bits"]), WORD_LINES, "0")))

    return F.split(F.array_join(F.transform(words, piece), ""), "")


def written_bitmap(words: Column) -> Column:
    """``word:bits`` in hexadecimal, comma-joined; a word that is not listed keeps all its lines."""
    return F.array_join(F.transform(words, lambda w: F.concat_ws(":", F.hex(w["word"]), F.hex(w["bits"]))), ",")


def with_kept_text(docs: DataFrame, least: int = 10) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with ``n_lines, n_dropped, words`` and its ``kept`` text."""
    bitmaps = materialize(drop_bitmaps(docs, least), "line-bitmaps").select(
        F.col("doc_id").alias("b_doc"), F.col("t1").alias("b_t1"), F.col("t2").alias("b_t2"), "n_dropped", "words")
    rows = docs.select("doc_id", "text", *_text_keys())
    joined = rows.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("t1") == F.col("b_t1"))
                       & (F.col("t2") == F.col("b_t2")), "left")
    lines = split_lines(text_or_empty())
    kept = F.filter(
        F.zip_with(lines, _dropped_flags(F.col("words")), lambda line, flag: F.when(F.coalesce(flag, F.lit("0")) == "0", line)),
        lambda line: line.isNotNull())
    return joined.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "words", F.when(F.col("words").isNull(), text_or_empty()).otherwise(F.array_join(kept, "\n")).alias("kept"))


def line_report(docs: DataFrame, least: int = 10) -> DataFrame:
    """Counts, the digest of the kept lines and the written bitmap of every row."""
    found = with_kept_text(docs, least)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"),
                        F.coalesce(written_bitmap(F.col("words")), F.lit("")).alias("dropped_words"))
