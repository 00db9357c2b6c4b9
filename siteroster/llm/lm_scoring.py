"""Language-model scoring of whole documents, with word counts of the whole training corpus.

Counts of all training words are gathered by Spark. The ``known`` most frequent
words go to the tasks (a bounded table); rarer words of a document are joined to
the counts, so every word is scored with its exact count. Texts are then taken
apart once: a table of the model's inputs, two bytes a token, is what all rounds
and the scoring read. The recurrent model's classes, biases and word shares come from these counts. Its weights start from a
fit to a small sample (about ``train_docs`` documents of lowest id hash, until
``train_tokens`` tokens are reached) and are then fitted to all training documents
in ``ROUNDS`` rounds: a round holds the documents of some text hashes, its tasks run
backpropagation over theirs from the shared weights, and the mean of the tasks'
weights, by tokens, is shared next. Every training document is in one round.

Defined results: null and empty texts are one end token; a null id trains;
repeated rows train and are scored each; texts of any length are read whole;
without training documents all counts are zero; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.llm.recurrent_lm import END, Model, Vocabulary, score_documents, train
from siteroster.llm.sampling import chosen_by_hash
from siteroster.session import materialize

#: Bytes of text that a task takes apart at once, and tokens that it fits or scores at once.
HELD_BYTES, HELD_TOKENS = 4 << 20, 1_000_000
#: Tokens above which a document is scored among long ones.
LONG = 2048
#: Rounds of the fit to all rows, lanes and step size of its tasks, and sums that a round leaves to the driver.
ROUNDS, LANES, RATE, SUMS = 4, 512, 0.01, 8
TRAINING = "not coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)"


def held_out(doc: int | None, parts: int = 7, part: int = 2) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % parts == part


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Groups:
    """Rows of batches regrouped: a group's values of ``column`` have at most ``most`` bytes, a longer one is alone."""

    def __init__(self, column: str, most: int):
        self.column, self.most, self.held, self.size = column, most, [], 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The groups that the batch fills."""
        lengths = pc.fill_null(pc.binary_length(batch.column(self.column)), 0).to_numpy(zero_copy_only=False)
        places, at = np.cumsum(np.concatenate([[self.size], lengths]), dtype=np.int64), 0
        while at < len(lengths):
            to = int(np.searchsorted(places[1:], self.most, "right"))
            if to == at and not self.held:
                to += 1
            if to > at:
                self.held.append(batch.slice(at, to - at))
            if to < len(lengths):
                yield from self.rest()
                places -= places[to]
            at = to
        self.size = int(places[-1])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.concat_batches(self.held)
            self.held, self.size = [], 0


def regrouped(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    groups = Groups(column, most)
    for batch in batches:
        yield from groups.add(batch)
    yield from groups.rest()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, the empty word as the end of each, and where each text's words start (and the last ones end)."""
    # sessions may send texts with large offsets, which a group of texts does not need
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    # the space behind a text leaves an empty last word, as an empty text does by itself
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(texts, "", " ")))
    return found.flatten(), found.offsets.to_numpy()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all training documents; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in regrouped(batches, "text", HELD_BYTES):
            rows = rows.filter(pa.array([not held_out(doc) for doc in rows.column("doc_id").to_pylist()], pa.bool_()))
            coded = split_words(rows.column("text"))[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, known: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``known`` words: all whose count is over a limit, most frequent first.

    The limit comes from how many words lie in each sixteenth of a power of two,
    so nothing is ordered or gathered but these words.
    """
    words = counts.where(F.length("word") > 0).withColumn("level", F.floor(F.log2("n") * 16))
    limit, total = None, 0
    for row in sorted(words.groupBy("level").count().collect(), reverse=True):
        total += row["count"]
        if total > known:
            break
        limit = row["level"]
    table = words.where(F.col("level") >= limit).select("word", "n").toArrow() if limit is not None else None
    found = sorted(zip(table.column("n").to_pylist(), table.column("word").to_pylist()),
                   key=lambda x: (-x[0], x[1])) if table else []
    return [w for _, w in found], np.array([n for n, _ in found], np.int64)


def _sample(docs: DataFrame, vocabulary: Vocabulary, train_docs: int, train_tokens: int) -> list[np.ndarray]:
    training = docs.where(TRAINING)
    chosen = training.where(chosen_by_hash(training, "doc_id", train_docs))
    sample, total = [], 0
    for row in chosen.select("text").toLocalIterator():
        if total >= train_tokens:
            break
        coded = encode(vocabulary, tokens(row[0]))
        sample.append(coded)
        total += len(coded)
    return sample


WEIGHTS = "task long, n long, weights binary"


def _weights_row(task: int, n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task]), pa.array([n]), pa.array([total.tobytes()], pa.binary())],
                                      ["task", "n", "weights"])


def _documents(codes: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in codes]


def _fit_task(vocabulary: Vocabulary, weights: np.ndarray, rate: float):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = Model(vocabulary), 0
        model.load(weights)
        for rows in regrouped(batches, "codes", 2 * HELD_TOKENS):
            coded = _documents(rows.column("codes"))
            held = sum(map(len, coded))
            # few tokens take few lanes, so that they still make many steps
            train(vocabulary, coded, 1, int(np.clip(held // 2048, 8, LANES)), rate, model)
            n += held
        if n:
            yield _weights_row(TaskContext.get().partitionId(), n, model.flat().astype(np.float64) * n)

    return fit


def _sum_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for count, data in zip(batch.column(1).to_pylist(), batch.column(2)):
            found = np.frombuffer(data.as_py(), np.float64)
            n, total = n + count, found.copy() if total is None else total + found
    if total is not None:
        yield _weights_row(TaskContext.get().partitionId(), n, total)


def fit_all(docs: DataFrame, vocabulary: Vocabulary, model: Model) -> int:
    """Fits ``model`` to all training rows, as texts or as ``code_documents`` left them; returns the tokens that the rounds read."""
    coded = code_documents(docs, vocabulary) if "text" in docs.columns else docs
    inputs, read = vocabulary.of_inputs(), 0
    for k in range(ROUNDS):
        part = coded.where(F.col("round") == k).select("codes")
        fitted = part.mapInArrow(_fit_task(inputs, model.flat(), RATE * 0.6 ** k), WEIGHTS)
        # tasks' sums meet in groups of 32, those in a fixed number
        tasks = max(1, part.rdd.getNumPartitions())
        for groups in (-(-tasks // 32), SUMS):
            fitted = fitted.repartition(groups, "task").mapInArrow(_sum_weights, WEIGHTS)
        rows = fitted.collect()
        n = sum(r["n"] for r in rows)
        if n:
            model.load(sum(np.frombuffer(r["weights"], np.float64) for r in rows) / n)
        read += n
    return read


def encode(vocabulary: Vocabulary, found: list[bytes]) -> np.ndarray:
    get, other = vocabulary.number.get, vocabulary.other
    ids = np.empty(len(found) + 1, np.int32)
    ids[:-1] = [get(w, other) for w in found]
    ids[-1] = END
    return ids


CODED = ("row long, doc_id long, round int, n_tokens long, n_known long, log_counts double, log_words double, n_rare long, "
         "codes binary, rare array<binary>, rare_n array<int>")
SCORED = "row long, doc_id long, n_tokens long, n_known long, log_counts double, n_rare long, log_model double"


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _coder(vocabulary: Vocabulary):
    words = pa.array([b"", *vocabulary.number], pa.binary()).cast(pa.string(), safe=False)
    other, token_in, counts = vocabulary.other, vocabulary.token_in.astype(np.uint16), vocabulary.counts
    log_count, within = np.append(vocabulary.log_count, 0.0), vocabulary.within

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 36, np.append(counts > 0, False).astype(np.int64)
        for rows in regrouped(batches, "text", HELD_BYTES):
            found, places = split_words(rows.column("text"))
            ids = pc.fill_null(pc.index_in(found, value_set=words), other).to_numpy()
            starts, n = places[:-1], np.diff(places)
            rare = np.flatnonzero(ids == other)
            owner = np.searchsorted(places, rare, "right") - 1
            named = found.take(pa.array(rare)).dictionary_encode()
            different = max(1, len(named.dictionary))
            pairs, times = np.unique(owner * different + named.indices.to_numpy(), return_counts=True)
            lists = np.searchsorted(pairs, np.arange(len(n) + 1) * different)
            codes = token_in[ids]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + len(n))), rows.column("doc_id"), rows.column("round"), pa.array(n, pa.int64()),
                pa.array(np.add.reduceat(known[ids], starts)), pa.array(np.add.reduceat(log_count[ids], starts)),
                pa.array(np.add.reduceat(within[ids], starts)), pa.array(np.bincount(owner, minlength=len(n)), pa.int64()),
                pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((places * 2).astype(np.int32)), pa.py_buffer(codes)]),
                _lists(lists, named.dictionary.take(pa.array(pairs % different)).cast(pa.binary())),
                _lists(lists, pa.array(times, pa.int32())),
            ], ["row", "doc_id", "round", "n_tokens", "n_known", "log_counts", "log_words", "n_rare", "codes", "rare", "rare_n"])
            number += len(n)

    return code


def code_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A table of all rows, taken apart once: the model's inputs as two bytes a token, the sums of the words' own logs,
    the words beyond the vocabulary with how often they occur, and the round that a training row is fitted in."""
    fitted_in = F.when(F.expr(TRAINING), F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS))).cast("int").alias("round")
    return materialize(docs.select("doc_id", "text", fitted_in).mapInArrow(_coder(vocabulary), CODED), "lm-coded")


def _scorer(vocabulary: Vocabulary, model: Model):
    def scored(rows: pa.RecordBatch) -> pa.RecordBatch:
        logs = score_documents(model, vocabulary, _documents(rows.column("codes"))) + rows.column("log_words").to_numpy()
        kept = ["row", "doc_id", "n_tokens", "n_known", "log_counts", "n_rare"]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(logs)], [*kept, "log_model"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # long documents are kept apart: their lanes run on where all others have ended, and do so once a task
        held = {False: Groups("codes", 2 * HELD_TOKENS), True: Groups("codes", 2 * HELD_TOKENS)}
        for batch in batches:
            long = pc.greater(batch.column("n_tokens"), LONG)
            for of, groups in held.items():
                for rows in groups.add(batch.filter(pc.equal(long, of))):
                    yield scored(rows)
        for groups in held.values():
            for rows in groups.rest():
                yield scored(rows)

    return score


def lm_scores(docs: DataFrame, known: int = 200_000, train_docs: int = 1200, train_tokens: int = 400_000) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    docs = docs.select("doc_id", "text")
    counts = materialize(word_counts(docs), "word-counts")
    total, distinct, ends = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)),
        F.coalesce(F.sum(F.when(F.col("word") == F.lit(b""), F.col("n"))), F.lit(0))).first()
    words, top_counts = frequent_words(counts, known)
    in_top = int(top_counts.sum()) + ends
    vocabulary = Vocabulary(words, top_counts, ends,
                            total - in_top, distinct - len(top_counts) - (ends > 0))
    model = train(vocabulary, _sample(docs, vocabulary, train_docs, train_tokens))
    coded = code_documents(docs, vocabulary)
    fit_all(coded, vocabulary, model)
    scored = materialize(coded.drop("round", "rare", "rare_n").mapInArrow(_scorer(vocabulary.of_inputs(), model), SCORED), "lm-scored")
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    base_mass, rare_mass = float(np.log10(total + distinct + 1)), float(np.log10(vocabulary.other_mass))
    logs = F.coalesce(F.col("rare_logs"), F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"),
        "n_tokens", (F.col("n_known") + F.coalesce(F.col("rare_known"), F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * F.lit(base_mass)).alias("base_score"),
        (F.col("log_model") + logs - F.col("n_rare") * F.lit(rare_mass)).alias("score"))
