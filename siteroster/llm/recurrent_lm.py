"""A gated recurrent language model in numpy, with a class-factored softmax over corpus counts.

Words are ranked by their count. The first ``HEAD`` (with the document end in
front) lie in classes of ``WIDTH`` words, and P(word) = P(class | state) P(word |
class, state). The other known words lie in bins of equal mass with P(word | bin)
taken from their counts, and all words beyond those share a last bin. Inputs are
head words or the bin of a word.

Training is truncated backpropagation with Adam: windows of ``WINDOW`` steps over
parallel lanes, the state handed from window to window, and set to zero where a
document starts. Scoring carries the state the same way through whole documents.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np

HEAD, WIDTH, BINS, HIDDEN, WINDOW = 1024, 32, 16, 16, 64
CLASSES = HEAD // WIDTH + BINS
START = HEAD + BINS
END = 0
#: Outputs that a scoring window aims at, and its most steps.
ROWS, MOST_STEPS = 1 << 14, 1024
#: Tokens of a document that training reads in one lane.
PART = 2048


class Vocabulary:
    """Ranked words with their counts; id 0 is the document end, ``len(words) + 1`` any other word."""

    def __init__(self, words: list[bytes], counts: np.ndarray, end_count: int, other_count: int, other_words: int):
        self.number = {w: i + 1 for i, w in enumerate(words)}
        self.other = len(words) + 1
        self.counts = np.concatenate([[end_count], counts]).astype(np.float64)
        self.log_count = np.log10(self.counts + 1)
        #: normaliser of the last bin: its words' counts, one more for each, and one for all unseen words
        self.other_mass = other_count + other_words + 1.0
        n = len(self.counts)
        rank = np.arange(n)
        head, known_bins = HEAD // WIDTH, BINS - 1
        mass = np.cumsum(self.counts[HEAD:] + 1)
        bins = np.minimum((mass / (mass[-1] + 1) * known_bins).astype(np.int64), known_bins - 1) if n > HEAD else mass
        self.cls = np.concatenate([rank[:HEAD] // WIDTH, head + bins, [CLASSES - 1]]).astype(np.int32)
        bin_mass = np.bincount(self.cls[HEAD:n], self.counts[HEAD:] + 1, CLASSES) if n > HEAD else np.ones(CLASSES)
        #: log10 P(word | bin) of known words in bins; zero for head words and for words of the last bin
        self.within = np.zeros(n + 1)
        self.within[HEAD:n] = np.log10((self.counts[HEAD:] + 1) / bin_mass[self.cls[HEAD:n]])
        self.slot = np.where(np.arange(n + 1) < HEAD, np.arange(n + 1) % WIDTH, -1).astype(np.int32)
        self.token_in = np.where(np.arange(n + 1) < min(HEAD, n), np.arange(n + 1), HEAD + self.cls - head).astype(np.int32)
        word = np.zeros(HEAD)
        word[:min(HEAD, n)] = self.counts[:HEAD]
        class_mass = np.bincount(self.cls[:n], self.counts, CLASSES)
        class_mass[-1] += other_count
        self.class_log = np.log((class_mass + 0.5) / (class_mass.sum() + 0.5 * CLASSES)).astype(np.float32)
        self.word_log = np.log(word + 0.5).reshape(-1, WIDTH).astype(np.float32)
        self.word_log[word.reshape(-1, WIDTH) == 0] = -20.0

    def of_inputs(self) -> Vocabulary:
        """This vocabulary with ids that are the model's inputs (head words and bins), which is all that fitting and scoring need;
        the words' shares of their bins are left out."""
        small = copy.copy(self)
        del small.number, small.other, small.counts, small.log_count
        ids = np.arange(START)
        small.cls = np.where(ids < HEAD, ids // WIDTH, HEAD // WIDTH + ids - HEAD).astype(np.int32)
        small.slot = np.where(ids < HEAD, ids % WIDTH, -1).astype(np.int32)
        small.token_in, small.within = ids.astype(np.int32), np.zeros(START)
        return small


def lanes(lengths: list[int], most: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest first; lanes in falling order of length."""
    heap = [(0, i, []) for i in range(min(most, len(lengths)))]
    for doc in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        total, i, docs = heapq.heappop(heap)
        docs.append(doc)
        heapq.heappush(heap, (total + lengths[doc], i, docs))
    return [docs for _, _, docs in sorted(heap, key=lambda x: -x[0])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tops(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the scores of each softmax (states lie between -1 and 1), and whether a bound may stand in for the largest score."""
    spread = np.abs(weights).sum(axis=-2)
    top = (bias + spread).max(axis=-1)
    return top, top - (bias - spread).max(axis=-1) < 60


def _softmax(scores: np.ndarray, bias: np.ndarray, top: float, safe: bool) -> np.ndarray:
    """Turns scores without bias into weights in place, all scaled alike in a row; returns their sums."""
    if safe:
        scores += bias - top
    else:
        scores += bias
        scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    return scores @ np.ones(scores.shape[1], np.float32)


def _sum_rows(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different places in order, and the sum of each one's rows."""
    order = np.argsort(places.astype(np.uint16), kind="stable")
    sorted_places = places[order]
    first = np.flatnonzero(np.r_[True, sorted_places[1:] != sorted_places[:-1]])
    return sorted_places[first], np.add.reduceat(rows[order], first, axis=0)


class Model:
    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "inputs": small(START + 1, 3 * HIDDEN), "state": small(HIDDEN, 3 * HIDDEN),
            "cls": small(HIDDEN, CLASSES), "cls_bias": vocabulary.class_log.copy(),
            "word": small(HEAD // WIDTH, HIDDEN, WIDTH), "word_bias": vocabulary.word_log.copy(),
        }

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, weights: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = weights[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def run(self, tokens: np.ndarray, resets: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step of a window; rows are steps. With ``keep`` also what backpropagation needs."""
        p, n = self.p, HIDDEN
        states, kept = np.empty((len(tokens), n, tokens.shape[1]), np.float32), []
        # inside, lanes are the last axis, so that a gate's values lie together
        inputs, state = np.ascontiguousarray(p["inputs"].T), np.ascontiguousarray(p["state"].T)
        h, reset = np.ascontiguousarray(h.T), resets.any(axis=1)
        for t in range(len(tokens)):
            if reset[t]:
                h = h * ~resets[t]
            x, u = inputs.take(tokens[t], axis=1), state @ h
            x[:2 * n] += u[:2 * n]
            gates = _sigmoid(x[:2 * n])
            z, r, inner, new = gates[:n], gates[n:], u[2 * n:], x[2 * n:]
            new += r * inner
            np.tanh(new, out=new)
            if keep:
                kept.append((h, z, r, new, inner))
            h = np.subtract(h, new, out=states[t])
            h *= z
            h += new
        return states.transpose(0, 2, 1), h.T.copy(), kept

    def outputs(self, states: np.ndarray, cls: np.ndarray, slot: np.ndarray, gradient: dict | None = None):
        """Natural log P(class) P(word | class) of flat states; with ``gradient`` also the states' gradients."""
        p = self.p
        # rows of a class lie together, so its part of every array is a view
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        states, cls, slot = states[order], cls[order], slot[order]
        rows = np.arange(len(cls))
        scores = states @ p["cls"]
        top, safe = _tops(p["cls"], p["cls_bias"])
        total = _softmax(scores, p["cls_bias"], top, safe)
        logs = np.log(np.maximum(scores[rows, cls], 1e-37) / total)
        back = None
        if gradient is not None:
            scores /= total[:, None]
            scores[rows, cls] -= 1
            gradient["cls"] += states.T @ scores
            gradient["cls_bias"] += scores.sum(axis=0)
            back = scores @ p["cls"].T
        edges = np.searchsorted(cls, np.arange(HEAD // WIDTH + 1))
        top, safe = _tops(p["word"], p["word_bias"])
        for c in np.flatnonzero(np.diff(edges)).tolist():
            some = slice(edges[c], edges[c + 1])
            inner = states[some] @ p["word"][c]
            total = _softmax(inner, p["word_bias"][c], top[c], safe[c])
            at = rows[:len(inner)]
            logs[some] += np.log(np.maximum(inner[at, slot[some]], 1e-37) / total)
            if gradient is not None:
                inner /= total[:, None]
                inner[at, slot[some]] -= 1
                gradient["word"][c] += states[some].T @ inner
                gradient["word_bias"][c] += inner.sum(axis=0)
                back[some] += inner @ p["word"][c].T
        found = np.empty_like(logs)
        found[order] = logs
        if back is None:
            return found, None
        placed = np.empty_like(back)
        placed[order] = back
        return found, placed


def backward(model: Model, tokens: np.ndarray, resets: np.ndarray, kept: list, d_states: np.ndarray, g: dict) -> None:
    """Backpropagation through a window: adds the gradients of ``inputs`` and ``state`` to ``g``."""
    n, steps, live = HIDDEN, *tokens.shape
    # as in ``run``, lanes are the last axis; what all steps add up has lanes as rows
    d_x, d_u = np.empty((2, steps, live, 3 * n), np.float32)
    x, u = np.empty((2, 3 * n, live), np.float32)
    d_z, d_r, d_new = x[:n], x[n:2 * n], x[2 * n:]
    d_h, d_states = np.zeros((n, live), np.float32), d_states.transpose(0, 2, 1)
    turned, reset = np.ascontiguousarray(model.p["state"].T), resets.any(axis=1)
    for t in range(steps - 1, -1, -1):
        before, z, r, new, inner = kept[t]
        d_h += d_states[t]
        off = 1 - z
        np.multiply(d_h, off, out=d_new)
        d_new *= 1 - new * new
        np.subtract(before, new, out=d_z)
        d_z *= d_h
        off *= z
        d_z *= off
        np.multiply(d_new, inner, out=d_r)
        d_r *= r * (1 - r)
        u[:2 * n] = x[:2 * n]
        np.multiply(d_new, r, out=u[2 * n:])
        d_x[t], d_u[t] = x.T, u.T
        d_h *= z
        d_h += (d_u[t] @ turned).T
        if reset[t]:
            d_h *= ~resets[t]
    g["state"] += np.concatenate([k[0].T for k in kept]).T @ d_u.reshape(-1, 3 * n)
    places, sums = _sum_rows(d_x.reshape(-1, 3 * n), tokens.ravel())
    g["inputs"][places] += sums


class Stream:
    """Documents laid out in lanes: inputs, targets, starts and owners by step, longest lanes first."""

    def __init__(self, vocabulary: Vocabulary, docs: list[np.ndarray], most: int):
        dealt = lanes([len(d) for d in docs], most)
        self.lengths = np.array([sum(len(docs[i]) for i in lane) for lane in dealt])
        self.targets = np.zeros((len(dealt), self.lengths.max()), np.int32)
        self.owner = np.full(self.targets.shape, -1, np.int32)
        self.resets = np.zeros(self.targets.shape, bool)
        for row, lane in enumerate(dealt):
            at = 0
            for i in lane:
                self.targets[row, at:at + len(docs[i])] = docs[i]
                self.owner[row, at:at + len(docs[i])] = i
                self.resets[row, at] = True
                at += len(docs[i])
        self.tokens = np.where(self.resets, START, np.roll(vocabulary.token_in[self.targets], 1, axis=1)).astype(np.int32)

    def windows(self, size: int):
        """Slices of time with the lanes that are still running."""
        for at in range(0, self.targets.shape[1], size):
            n = int(np.searchsorted(-self.lengths, -at, side="left"))
            yield n, slice(at, min(at + size, self.targets.shape[1]))


def score_documents(model: Model, vocabulary: Vocabulary, docs: list[np.ndarray], most: int = 1024) -> np.ndarray:
    """log10 P of whole documents (each ends with the end id); words of the last bin count P(bin) alone."""
    stream = Stream(vocabulary, docs, most)
    h, result = np.zeros((len(stream.lengths), HIDDEN), np.float32), np.zeros(len(docs))
    # few lanes take longer windows, so that a window's outputs are many
    for n, time in stream.windows(max(WINDOW, min(MOST_STEPS, ROWS // len(stream.lengths)))):
        states, h, _ = model.run(stream.tokens[:n, time].T, stream.resets[:n, time].T, h[:n])
        owner, target = stream.owner[:n, time].T.ravel(), stream.targets[:n, time].T.ravel()
        real = owner >= 0
        target, owner = target[real], owner[real]
        logs, _ = model.outputs(states.reshape(-1, HIDDEN)[real], vocabulary.cls[target], vocabulary.slot[target])
        result += np.bincount(owner, logs / np.log(10) + vocabulary.within[target], len(docs))
    return result


def window_gradients(
    model: Model, vocabulary: Vocabulary, tokens: np.ndarray, resets: np.ndarray, target: np.ndarray, real: np.ndarray, h: np.ndarray,
) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of minus the natural log likelihood of a window's real targets, those logs, and the state after it."""
    states, after, kept = model.run(tokens, resets, h, keep=True)
    g = {k: np.zeros_like(v) for k, v in model.p.items()}
    logs, back = model.outputs(states.reshape(-1, HIDDEN)[real], vocabulary.cls[target[real]], vocabulary.slot[target[real]], g)
    d_states = np.zeros((tokens.size, HIDDEN), np.float32)
    d_states[real] = back
    backward(model, tokens, resets, kept, d_states.reshape(states.shape), g)
    return g, logs, after


def train(vocabulary: Vocabulary, docs: list[np.ndarray], epochs: int = 3, most: int = 48, rate: float = 0.01,
          model: Model | None = None) -> Model:
    """Fits ``model``, or a new one, to documents; its weights are changed in place."""
    model = model or Model(vocabulary)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    if not docs:
        return model
    # a very long document is fitted in parts, so that its lane does not run on alone; it is scored whole
    stream = Stream(vocabulary, [d[at:at + PART] for d in docs for at in range(0, len(d), PART)], most)
    for _ in range(epochs):
        h = np.zeros((len(stream.lengths), HIDDEN), np.float32)
        for live, time in stream.windows(WINDOW // 2):
            owner, target = stream.owner[:live, time].T.ravel(), stream.targets[:live, time].T.ravel()
            real = np.flatnonzero(owner >= 0)
            g, _, h = window_gradients(
                model, vocabulary, stream.tokens[:live, time].T, stream.resets[:live, time].T, target, real, h[:live])
            step += 1
            scale = 1 / max(1, len(real))
            for k, v in g.items():
                v *= scale
                np.clip(v, -1, 1, out=v)
                first[k] += 0.1 * (v - first[k])
                v *= v
                second[k] += 0.001 * (v - second[k])
                model.p[k] -= (rate / (1 - 0.9 ** step)) * first[k] / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-6)
        rate *= 0.6
    return model
