"""Secret scan: fixed patterns, and random strings told from identifiers by character Markov models.

Two first-order character models are fitted to labelled samples: random strings
(digests, base64, base32, written by Spark from their numbers) and ordinary
identifiers (words of documents, alone and joined in the usual ways, and plain numbers). A run of
token characters is a secret if the log-likelihood ratio of the two models is
over a limit both in sum and for each character.

Defined results: a null text is empty and has no spans; texts are scanned whole,
also very long ones; every row of the input gives one row, repeated rows too;
other columns of the input are kept unless the result has that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.llm.arrays import let, running_most, running_sums
from siteroster.llm.sampling import chosen_by_hash
from siteroster.llm.words import WORD, text_or_empty, words

#: Kinds in their listed order, the patterns of the base scan, least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 8
#: As long runs are maximal, a least length in the pattern gives the matches of ``+`` that are long enough.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
TOKEN = "[A-Za-z0-9+/_-]{16,}"
SIZE = len(ALPHABET)
#: Code points of a block of text in which places are looked up.
BLOCK = 1024


def random_samples(spark: SparkSession, count: int) -> DataFrame:
    """``count`` labelled random strings, the same on every run."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample "), i.cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    upper = F.translate(F.upper(coded), "+/=01", "AZQ23")
    kind = i % 4
    value = (F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.substring(coded, 1, 40))
             .when(kind == 2, F.substring(upper, 1, 20)).otherwise(F.translate(F.substring(coded, 1, 32), "+/", "-_")))
    return spark.range(count).select(value.alias("value"))


def identifier_samples(docs: DataFrame, documents: int) -> DataFrame:
    """Words of a sample of about ``documents`` documents (lowest hashes of the id), plain and joined as identifiers."""
    sample = docs.where(chosen_by_hash(docs, "doc_id", documents)).select(text_or_empty().alias("text"))
    plain = F.filter(words(F.regexp_replace("text", "[^A-Za-z]+", " ")), lambda w: F.length(w) >= 3)
    pair = sample.select(plain.alias("all")).select(F.explode(F.zip_with(
        "all", F.slice("all", 2, F.size("all")),
        lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    return pair.select(F.explode(F.array(
        a, b, F.upper(a), F.concat(a, F.initcap(b)), F.concat_ws("_", F.lower(a), F.lower(b)),
        F.concat_ws("-", F.lower(a), F.lower(b)), F.concat_ws("_", F.upper(a), F.upper(b)),
        F.concat_ws("/", a, F.lower(b)), F.concat(F.lower(a), (F.length(b) + 2014).cast("string")),
        F.conv(F.substring(F.sha2(F.concat(a, b), 256), 1, 14), 16, 10),
    )).alias("value"))


def _steps(value: Column) -> Column:
    """The two-character steps of a string."""
    return F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, 2))


def fit_ratio(docs: DataFrame, samples: int = 8000, documents: int = 400) -> list[float]:
    """Log ratio of P(next | character) under the two models: a fixed table of 66 x 66 numbers.

    ``samples`` and ``documents`` bound the labelled samples; counting is done by
    Spark and at most two counts for each step of the alphabet reach the driver.
    """
    spark = docs.sparkSession
    both = random_samples(spark, samples).withColumn("random", F.lit(True)).union(
        identifier_samples(docs, documents).withColumn("random", F.lit(False)))
    steps = both.where(F.length("value") > 1).select("random", F.explode(_steps(F.col("value"))).alias("step"))
    counts = {(row["random"], row["step"]): row["n"] for row in steps.groupBy("random", "step").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    ratio = []
    for a in ALPHABET:
        seen = {kind: [counts.get((kind, a + b), 0) + 0.5 for b in ALPHABET] for kind in (True, False)}
        total = {kind: sum(n) for kind, n in seen.items()}
        ratio += [math.log(r / total[True]) - math.log(o / total[False]) for r, o in zip(seen[True], seen[False])]
    return ratio


def _matches(text: Column, pattern: str, kind: str, least_group: int = 0) -> Column:
    """Spans ``(start, kind, end)`` of all matches: places are running sums over the pieces that the pattern leaves."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(found, lambda m: F.length(m))
    # the piece behind the last match has no length beside it
    steps = lambda n: F.slice(F.zip_with(
        F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece)), n,
        lambda gap, length: gap + F.coalesce(length, F.lit(0))), 1, F.size(n))
    spans = let(lengths, lambda n: F.zip_with(
        running_sums(steps(n)), n, lambda end, length: F.struct(
            (end - length).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))))
    if least_group:
        kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= least_group)
        spans = F.filter(F.zip_with(spans, kept, lambda span, long: F.when(long, span)), lambda span: span.isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.lit([]).cast(SPANS))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(runs: Column, base: Column) -> Column:
    """The ``runs`` that no span of ``base`` meets; runs are disjoint and in order.

    As many spans have to start before a run's end as have ended by its start. Both are
    running counts along the sorted places of spans and runs.
    """
    def counted(span_place: str, run_place: str, run_first: bool) -> Column:
        event = lambda place, of_run: F.struct(
            place.alias("at"), F.lit(int(of_run != run_first)).alias("turn"), F.lit(int(not of_run)).alias("one"))
        events = F.array_sort(F.concat(F.transform(base, lambda s: event(s[span_place], False)),
                                       F.transform(runs, lambda r: event(r[run_place], True))))
        return let(events, lambda e: F.filter(
            F.zip_with(running_sums(F.transform(e, lambda x: x["one"])), e, lambda n, x: F.when(x["one"] == 0, n)),
            lambda n: n.isNotNull()))

    begun, ended = counted("start", "end", True), counted("end", "start", False)
    free = F.zip_with(begun, ended, lambda x, y: x == y)
    kept = F.filter(F.zip_with(runs, free, lambda r, is_free: F.when(is_free, r)), lambda r: r.isNotNull())
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(kept)


def _random_spans(text: Column, ratio: list[float], least_sum: float, least_mean: float) -> Column:
    """Spans of the token runs that the models take for random strings."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")
    place = lambda step, i: F.instr(F.lit(ALPHABET), F.substring(step, i, 1)) - 1
    score = lambda value: F.aggregate(
        _steps(value), F.lit(0.0), lambda total, step: total + F.get(table, place(step, 1) * SIZE + place(step, 2)))
    secret = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda value: let(
        score(value), lambda x: (x >= least_sum) & (x >= least_mean * F.length(value))))
    spans = F.filter(F.zip_with(_matches(text, TOKEN, "random"), secret, lambda r, kept: F.when(kept, r)), lambda r: r.isNotNull())
    return F.when(text.rlike(TOKEN), spans).otherwise(F.lit([]).cast(SPANS))


def scan_secrets(docs: DataFrame, ratio: list[float], least_sum: float = 12.0, least_mean: float = 0.5) -> DataFrame:
    """Adds ``base_spans`` and ``all_spans`` (sorted arrays of start, kind, end in code points) to every row.

    A run that meets a span of the base scan is left to it. The work is near linear in
    the length of a text: no step looks a place up in the text or in all other spans.
    """
    text = text_or_empty()
    base = F.array_sort(F.concat(
        _matches(text, ASSIGN, "assign", ASSIGN_LEAST), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex")))
    both = let(base, lambda b: F.struct(b.alias("base"), let(
        _random_spans(text, ratio, least_sum, least_mean),
        lambda runs: F.array_sort(F.concat(b, _apart(runs, b)))).alias("all")))
    found = docs.withColumn("all_spans", both)
    return found.withColumns({"base_spans": F.col("all_spans.base"), "all_spans": F.col("all_spans.all")})


def secret_report(docs: DataFrame, **limits: float) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans written out."""
    docs = docs.select("doc_id", "text")
    found = scan_secrets(docs, fit_ratio(docs), **limits)
    count = lambda kind: F.size(F.filter(
        "base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each group of overlapping spans (sorted by start).

    A gap before a span runs from the furthest end so far. The text is cut into blocks
    first, so that taking a gap out walks a block and not the text.
    """
    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        of = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        return F.when(first == last, F.substring(of(first), start % BLOCK + 1, end - start)).otherwise(F.concat(
            F.substring(of(first), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""),
            F.substring(of(last), F.lit(1), end % BLOCK)))

    def pieces(blocks: Column, ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        marked = F.filter(F.zip_with(spans, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"))),
                          lambda gap: gap["start"] >= gap["at"])
        tail = cut(blocks, F.element_at(ends, -1), F.length(text))
        return F.concat(F.array_join(F.transform(marked, lambda gap: F.concat(cut(blocks, gap["at"], gap["start"]), F.lit(mark))), ""), tail)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: let(
        running_most(F.transform(spans, lambda s: s["end"])), lambda ends: pieces(blocks, ends)))


def redact(docs: DataFrame, mark: str = "[SECRET]", **limits: float) -> DataFrame:
    """The input with every span of its text replaced by ``mark``; spans that overlap become one mark."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = scan_secrets(rows, fit_ratio(docs), **limits)
    clean = F.when(F.size("all_spans") > 0, let(F.col("all_spans"), lambda spans: _without(F.col("text"), spans, mark))).otherwise(F.col("text"))
    return found.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
