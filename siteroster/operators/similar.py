"""Similar company names.

Similarity is ``SequenceMatcher(None, earlier, later).ratio()`` over trimmed
lower-case names.  The join around it never compares all names with all:

* A pair with ratio ≥ t has matching blocks of M ≥ t/2·(la+lb) characters in
  at most la+lb−2M+1 blocks, so it shares at least (1.5t−1)(la+lb)−1 bigrams
  (counted with repeats).  This is a lossless lower bound ("need" below).
* Likewise they share at least (2.5t−2)(la+lb)−2 trigrams. From t = 0.84 on, names go
  by trigrams, which separate much better (digests have 256 bigrams in all), and
  only those so short that this bound is not positive go by bigrams beside them.
* Order the grams of a name from rare to frequent.  Two names that share
  ``need`` grams share one of them inside their first ``n − need + 1`` ones:
  these are the blocking keys, less than one per character.  (``key_size`` k
  takes all k-subsets of a head that is longer by k − 1 instead: fewer
  candidates for many more keys.)
* Where two lengths sum up to so little that the bound is not positive, names
  need not share a bigram.  Such short names also go by single characters, of
  which they share at least t/2·(la+lb).  Both bounds hold for t > 2/3.
* Length and shared-bigram tests run in the join, the latter on bitmaps that
  bound the shared number from above; only survivors reach the vectorised
  Python scorer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteroster.functions.text import let, strip
from siteroster.operators.ranking import dedup_domain, first_per_key
from siteroster.session import materialize

#: Thresholds must lie above this one, where shared bigrams no longer bound the ratio.
MIN_THRESHOLD = 2 / 3
#: From this threshold on only short names lack a shared trigram.
TRIGRAM_THRESHOLD = 0.84
_BUCKETS = 1 << 16
_WORDS = 4
_MAX_HOT = 100_000
GROUP_LIMIT = 50_000
_EPS = 1e-9


def name_key(name: Column) -> Column:
    return strip(F.lower(F.coalesce(name, F.lit("None"))))


def _ratio_at_least(threshold: float):
    @F.pandas_udf("boolean")
    def score(earlier: pd.Series, later: pd.Series) -> pd.Series:
        matcher = SequenceMatcher(None)
        out = []
        for a, b in zip(earlier, later):
            matcher.set_seqs(a, b)
            # the two quick ratios are upper bounds of the exact one
            out.append(
                matcher.real_quick_ratio() >= threshold
                and matcher.quick_ratio() >= threshold
                and matcher.ratio() >= threshold
            )
        return pd.Series(out, dtype=bool)

    # Keeps the optimizer from scoring candidates before they are made distinct.
    return score.asNondeterministic()


def _shared(total, threshold: float, q: int):
    """Lower bound of the ``q``-grams that similar names of ``total`` characters share."""
    return total * ((q - 0.5) * threshold - (q - 1)) - (q - 1) - _EPS


def _need(length: int, threshold: float, q: int = 2) -> int:
    partner = math.ceil(length * threshold / (2 - threshold) - _EPS)
    return math.ceil(_shared(length + partner, threshold, q))


def _smallest_total(length: Column, threshold: float) -> Column:
    return length + F.ceil(length * F.lit(threshold / (2 - threshold)) - _EPS)


def _need_column(length: Column, threshold: float, q: int = 2) -> Column:
    return F.ceil(_shared(_smallest_total(length, threshold), threshold, q)).cast("int")


def _bigrams(key: Column) -> Column:
    return _grams(key, 2)


def _grams(key: Column, q: int) -> Column:
    """Bigrams or trigrams with their running number, so that sets count repeats.

    The text up to a gram's end is shorter by its length for each of them when they
    are taken out; only those that begin and end alike overlap and are counted singly.
    """
    def numbered(i: Column) -> Column:
        gram, text = key.substr(i, F.lit(q)), F.left(key, i + (q - 1))
        taken = F.floor((F.length(text) - F.length(F.replace(text, gram))) / q)
        single = F.size(F.filter(F.sequence(F.lit(1), i), lambda j: key.substr(j, F.lit(q)) == gram))
        twin = F.left(gram, F.lit(1)) == F.right(gram, F.lit(1))
        return F.concat(gram, F.when(twin, single).otherwise(taken).cast("string"))

    return F.when(
        F.length(key) >= q, F.transform(F.sequence(F.lit(1), F.length(key) - (q - 1)), numbered)
    ).otherwise(F.array().cast("array<string>"))


def _numbered(parts: Column) -> Column:
    """Each part with its running number among equal ones."""
    return let(
        parts,
        lambda g: F.transform(
            g,
            lambda x, i: F.concat(
                x, F.size(F.filter(F.slice(g, 1, i + 1), lambda y: y == x)).cast("string")
            ),
        ),
    )


def _subsets(head: Column, size: int) -> Column:
    """Hashes of all ``size``-element subsets of the (sorted) head."""

    def rest(i: Column) -> Column:
        return F.slice(head, i + 2, F.size(head))

    if size == 1:
        return F.transform(head, lambda x: F.xxhash64(x))
    if size == 2:
        return F.flatten(
            F.transform(head, lambda x, i: F.transform(rest(i), lambda y: F.xxhash64(x, y)))
        )
    return F.flatten(
        F.transform(
            head,
            lambda x, i: F.flatten(
                F.transform(
                    F.slice(head, i + 2, F.size(head)),
                    lambda y, j: F.transform(
                        F.slice(head, i + j + 3, F.size(head)), lambda z: F.xxhash64(x, y, z)
                    ),
                )
            ),
        )
    )


def _gram_bits(places: Column) -> list[Column]:
    """The bigram set, hashed to places, as a bitmap of four 64-bit words."""

    def word(w: int) -> Column:
        mine = F.filter(places, lambda p: F.floor(p / 64) == w)
        bits = F.aggregate(
            mine,
            F.lit(0).cast("bigint"),
            lambda acc, p: acc.bitwiseOR(
                F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(p, F.lit(64)))
            ),
        )
        return bits.alias(f"bits{w}")

    return [word(w) for w in range(_WORDS)]


def _shared_at_most() -> Column:
    """Upper bound of the bigrams two names share: each bit of one that the other
    lacks stands for at least one bigram it lacks.

    The bits that only ``b`` has follow from the numbers of bits. Each bitmap is read
    once: this test runs for every pair under a key.
    """
    lacking = F.lit(0)
    for w in range(_WORDS):
        lone = F.col(f"a.bits{w}").bitwiseAND(F.bitwise_not(F.col(f"b.bits{w}")))
        lacking = lacking + F.bit_count(lone)
    return F.least(F.col("a.n_grams"), F.col("b.n_grams") - F.col("b.n_bits") + F.col("a.n_bits")) - lacking


def _short_keys(key: Column, threshold: float) -> Column:
    """Single characters (with running numbers) of names short enough to lack a shared bigram, else nothing."""
    length = F.length(key)
    partner = F.ceil(length * F.lit(threshold / (2 - threshold)) - _EPS)
    need = F.greatest(F.ceil((length + partner) * F.lit(threshold / 2) - _EPS), F.lit(1)).cast("int")
    none = F.array().cast("array<bigint>")
    # any order that all names share will do for the head of rare ones
    hashes = F.array_sort(F.transform(_numbered(F.split(key, "")), lambda c: F.xxhash64(F.lit("character"), c)))
    return F.when((length + partner) * F.lit(1.5 * threshold - 1) <= 1 + _EPS, F.slice(hashes, 1, length - need + 1)).otherwise(none)


def blocking_keys(names: DataFrame, threshold: float, key_size: int = 1) -> DataFrame:
    """Blocking keys (``sig``) of unique names ``key, ord``, one row each."""
    if not MIN_THRESHOLD < threshold <= 1:
        raise ValueError(f"threshold must lie in ({MIN_THRESHOLD:.3f}, 1]")
    length = F.length("key")
    sizes = [3, 2] if threshold >= TRIGRAM_THRESHOLD else [2]
    # the first size is for all names; the next one for those that may share none of the one before
    may_lack = _shared(_smallest_total(length, threshold), threshold, sizes[0]) <= 0
    none = F.array().cast("array<struct<q:int,token:string>>")
    tokens = F.concat(*[
        F.when(F.lit(q == sizes[0]) | may_lack, F.transform(_grams(F.col("key"), q), lambda t: F.struct(F.lit(q).alias("q"), t.alias("token")))).otherwise(none)
        for q in sizes
    ])
    grams = names.withColumn("gram", F.explode(tokens)).select("key", "ord", "gram.*").withColumn(
        "bucket", F.pmod(F.hash("token"), F.lit(_BUCKETS))
    )
    # At most 65,536 rows whatever the number of names: safe to broadcast.
    frequency = grams.groupBy("bucket").agg(F.count("*").alias("n"))
    ranked = (
        grams.join(F.broadcast(frequency), "bucket")
        .groupBy("key")
        .agg(
            F.min("ord").alias("ord"),
            F.sort_array(F.collect_list(F.struct("n", "token", "q"))).alias("ranked"),
        )
    )
    # columns of their own: each is worked out once a name and used several times
    for q in sizes:
        ranked = ranked.withColumn(
            f"tokens{q}", F.transform(F.filter("ranked", lambda r: r["q"] == q), lambda r: r["token"]))
    ranked = ranked.withColumn("bigrams", _bigrams(F.col("key")))
    ranked = ranked.withColumn("places", F.transform("bigrams", lambda t: F.pmod(F.hash(t), F.lit(64 * _WORDS))))

    def keys(q: int) -> Column:
        need = F.greatest(_need_column(length, threshold, q), F.lit(1))
        size = F.size(f"tokens{q}")

        def head(k: int) -> Column:
            # none where the name has no grams of this size
            return F.slice(f"tokens{q}", 1, F.greatest(F.least(size, size - need + k), F.lit(0)))

        found = let(head(key_size), lambda h: _subsets(h, key_size))
        if key_size == 1:
            return found
        # Names too short for k shared grams, and whatever may resemble them, go by single ones.
        shortest = max((n for n in range(1, 64) if _need(n, threshold, q) < key_size), default=0)
        single_up_to = math.floor(shortest * (2 - threshold) / threshold + _EPS)
        short = F.when(length <= single_up_to, _subsets(head(1), 1))
        return F.concat(found, F.coalesce(short, F.array().cast("array<bigint>")))

    sigs = ranked.select(
        "key",
        "ord",
        length.alias("length"),
        F.size("bigrams").alias("n_grams"),
        *_gram_bits(F.col("places")),
        F.array_distinct(F.concat(*[keys(q) for q in sizes], _short_keys(F.col("key"), threshold))).alias("sigs"),
    )
    n_bits = sum((F.bit_count(f"bits{w}") for w in range(_WORDS)), F.lit(0))
    sigs = sigs.withColumn("n_bits", n_bits)
    return sigs.withColumn("n_sig", F.size("sigs")).withColumn("sig", F.explode("sigs")).drop("sigs")


def _may_match(threshold: float) -> Column:
    la, lb = F.col("a.length"), F.col("b.length")
    total = la + lb
    return (
        # the bitmaps turn nearly all away; the order is a struct and costs most
        (_shared_at_most() >= total * (1.5 * threshold - 1) - 1 - _EPS)
        & (F.least(la, lb) * 2.0 >= total * (threshold - _EPS))
        & (F.col("a.ord") < F.col("b.ord"))
    )


def _candidates(
    heads: DataFrame, members: DataFrame, threshold: float, group_limit: int
) -> DataFrame:
    """Pairs sharing a key that pass the length and bigram bounds, earlier name first."""
    heads, members = _spread(heads, members, group_limit)
    same_group = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.salt") == F.col("b.salt"))
    return (
        heads.alias("a")
        .join(members.alias("b"), same_group & _may_match(threshold))
        .select(F.col("a.key").alias("earlier"), F.col("b.key").alias("later"))
    )


def _score(candidates: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs that are similar."""
    return candidates.distinct().where(_ratio_at_least(threshold)("earlier", "later"))


def _spread(
    heads: DataFrame, members: DataFrame, group_limit: int
) -> tuple[DataFrame, DataFrame]:
    """Add ``salt``: members of a hot key go to several groups, its heads to each of them.

    Keys below the limit are left alone.  At most ``_MAX_HOT`` keys can exceed
    the limit used, so the list of hot keys may always be broadcast.
    """
    total = members.count()
    limit = max(group_limit, total // _MAX_HOT)
    if total <= limit:
        return heads.withColumn("salt", F.lit(0)), members.withColumn("salt", F.lit(0))
    sizes = members.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot = F.broadcast(
        materialize(sizes.select("sig", F.ceil(F.col("n") / limit).cast("int").alias("salts")), "hot-keys")
    )
    salts = F.coalesce("salts", F.lit(1))
    spread_heads = heads.join(hot, "sig", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    spread_members = members.join(hot, "sig", "left").withColumn(
        "salt", F.pmod(F.hash("key"), salts)
    )
    return spread_heads, spread_members


def _unique_names(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    rows = df.select(name_key(F.col(name)).alias("key"), F.struct(*order).alias("ord"))
    return rows.groupBy("key").agg(F.min("ord").alias("ord"))


def similar_name_pairs(
    df: DataFrame,
    order: Sequence[str],
    name: str = "name",
    threshold: float = 0.85,
    key_size: int = 1,
) -> DataFrame:
    """All pairs ``earlier, later`` of distinct names at or above the threshold."""
    names = materialize(_unique_names(df, name, order), "unique-names")
    keys = materialize(blocking_keys(names, threshold, key_size), "name-keys")
    return _score(_candidates(keys, keys, threshold, GROUP_LIMIT), threshold)


def kept_names(
    names: DataFrame,
    threshold: float = 0.85,
    key_size: int = 1,
    head_size: int = 1,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Names a first-come-first-kept pass would keep, computed in rounds.

    Per round only the first ``head_size`` open names of each blocking key
    (the heads) are compared with the names after them.  A name that is a head
    under all of its keys is settled: every earlier open name it could resemble
    is a head too, so it can be decided; names similar to a kept one drop out.
    So a large group of near-copies costs one pass over the group, not its
    square.  ``head_size`` grows eightfold per round: the number of rounds is
    logarithmic in the largest group, and no pair is ever left out.
    """
    open_keys = materialize(blocking_keys(names, threshold, key_size), "open-names")
    # Names without a bigram resemble nothing but themselves.
    kept = names.where(F.length("key") < 2).select("key")
    while not open_keys.isEmpty():
        place = F.row_number().over(Window.partitionBy("sig").orderBy("ord"))
        heads = open_keys.withColumn("place", place).where(F.col("place") <= head_size)
        heads = materialize(heads, "name-heads")
        settled = (
            heads.groupBy("key")
            .agg(F.count("*").alias("n"), F.first("n_sig").alias("n_sig"))
            .where("n = n_sig")
            .select("key")
        )
        settled = materialize(settled, "settled-names")
        # Only settled names can be kept now.  That takes what they resemble
        # before them, and what resembles them after; other pairs can wait.
        after = _candidates(heads.join(settled, "key", "left_semi"), open_keys, threshold, group_limit)
        before = _candidates(heads, open_keys.join(settled, "key", "left_semi"), threshold, group_limit)
        edges = materialize(_score(after.unionByName(before), threshold), "name-edges")
        new_kept, dropped = _decide(edges, settled)
        kept = materialize(kept.unionByName(new_kept), "kept-names")
        done = new_kept.unionByName(dropped).distinct()
        open_keys = materialize(open_keys.join(done, "key", "left_anti"), "open-names")
        head_size *= 8
    return kept


def _decide(edges: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Greedy outcome on the similar pairs of one round: kept names, dropped names."""
    waiting = edges.select(F.col("later").alias("key")).distinct()
    kept = settled.join(waiting, "key", "left_anti")
    fresh = kept
    dropped = None
    while not edges.isEmpty():
        hit = edges.join(fresh.select(F.col("key").alias("earlier")), "earlier", "left_semi")
        gone = materialize(hit.select(F.col("later").alias("key")).distinct(), "dropped-names")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = edges.join(
            gone.select(F.col("key").alias("earlier")), "earlier", "left_anti"
        ).join(gone.select(F.col("key").alias("later")), "later", "left_anti")
        rest = materialize(rest, "name-edges")
        freed = (
            edges.select(F.col("later").alias("key"))
            .distinct()
            .join(settled, "key", "left_semi")
            .join(gone, "key", "left_anti")
            .join(rest.select(F.col("later").alias("key")), "key", "left_anti")
        )
        fresh = materialize(freed, "kept-names")
        if fresh.isEmpty():
            break
        kept = kept.unionByName(fresh)
        edges = rest
    if dropped is None:
        dropped = kept.limit(0)
    return kept, dropped


def dedup_similar_names(
    df: DataFrame,
    order: Sequence[str],
    name: str = "company_name",
    threshold: float = 0.85,
    key_size: int = 1,
) -> DataFrame:
    """Drop a row when an earlier row that was itself kept has a similar name."""
    keyed = df.withColumn("_key", name_key(F.col(name)))
    first = first_per_key(keyed, ["_key"], order)
    names = first.select(F.col("_key").alias("key"), F.struct(*order).alias("ord"))
    kept = kept_names(materialize(names, "unique-names"), threshold, key_size)
    return first.join(kept.withColumnRenamed("key", "_key"), "_key", "left_semi").drop("_key")


def deduplicate(
    df: DataFrame,
    order: Sequence[str],
    name: str = "company_name",
    url: str = "url",
    threshold: float = 0.85,
) -> DataFrame:
    """One row per site, then one per similar company name."""
    return dedup_similar_names(dedup_domain(df, order, url), order, name, threshold)
