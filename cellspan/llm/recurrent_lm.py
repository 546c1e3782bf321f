"""Language model scores: a gated recurrent network with a class-factored softmax.

Every token (a word, or the end of a text) belongs to a class, and the network gives the
class from its state.  Classes of the short list, of about equal root mass, also give
the word from the state.  All other words, seen or not, lie in open classes: intervals
of the reversed spelling, learnt so that each holds about an equal share of the counted
words; there the word follows its smoothed count in the whole training corpus.  The
probabilities of all words of an open class and of one unseen word sum to one, so the
score is a proper log probability of a whole text.

The recurrence is h' = z h + (1 - z) n, with the gate z and the candidate n of the word
that is read.  It is linear in h, so the states of many windows are found at once and
then joined in order: a text's state goes through all of it, whatever its length.

Training is truncated backpropagation in numpy on all training texts, as local steps on
every partition with the parameters averaged after each round.  The state is carried
over window borders, gradients stop there.
"""

from __future__ import annotations

import gc
import pickle
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, slices

END = b"\n"
HIDDEN = 32
SHORT_LIST = 2048
SHORT_CLASSES = 32
OPEN_CLASSES = 48
#: Words whose counts go to every task; all others get theirs by a join.
KNOWN_WORDS = 1 << 16
ROUNDS = 2
#: Tokens of a window, and streams that windows are taken from side by side.
WINDOW = 32
STREAMS = 256
#: Tokens that are scored together.
BLOCK = 1 << 15
TALLY = 200_000
#: Parts of the parameters, and groups of partitions, that are summed each in a task.
PARTS, FAN_IN = 16, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    words.append(END)
    return words


def count_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), c: counts of all tokens of all rows.

    Each partition adds up its words before the shuffle, in tables of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(tally.keys()), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["word", "c"])
            tally.clear()
            return out

        for piece in slices(batches):
            for t in piece.column("text").to_pylist():
                tally.update(tokens_of(t))
                if len(tally) > TALLY:
                    yield flush()
        yield flush()

    pieces = rows.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word binary, c long")
    return pieces.groupBy("word").agg(F.sum("c").alias("c"))


# -- the network -----------------------------------------------------------------
@dataclass
class Lexicon:
    """Known words in order of class: first those of the short list, then the others.

    ``known`` gives a word's number; ``cls``, ``inputs`` and ``counts`` go by number.
    A number below ``listed`` is also the word's column in the output.
    """

    known: dict[bytes, int]
    counts: np.ndarray
    cls: np.ndarray
    #: first number of every short class, and the end of the last
    starts: np.ndarray
    #: reversed spellings at which open classes after the first begin
    borders: list[bytes]
    total: int
    distinct: int
    open_total: np.ndarray
    open_distinct: np.ndarray
    cache: dict = field(default_factory=dict, repr=False)

    @property
    def listed(self) -> int:
        return int(self.starts[-1])

    @property
    def short_classes(self) -> int:
        return len(self.starts) - 1

    def open_class(self, word: bytes) -> int:
        return open_class(word, self.borders)

    @property
    def base_denominator(self) -> float:
        return float(np.log10(self.total + self.distinct + 1.0))

    def open_denominators(self) -> np.ndarray:
        return np.log10(self.open_total + self.open_distinct + 1.0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; -1 - (open class) for a word that isn't known."""
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(out < 0)
        borders = self.borders
        out[miss] = [-1 - bisect_right(borders, words[i][::-1]) for i in miss.tolist()]
        return out

    def classes(self, numbers: np.ndarray) -> np.ndarray:
        """Class of every token; open classes come after the short ones."""
        return np.where(numbers >= 0, self.cls[numbers], self.short_classes - 1 - numbers)

    def inputs(self, numbers: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Row of the input table: a short word has its own, others that of their class."""
        return np.where((numbers >= 0) & (numbers < self.listed), numbers, self.listed - self.short_classes + classes)


def open_class(word: bytes, borders: list[bytes]) -> int:
    """The interval of the reversed spelling that a word lies in, known or not."""
    return bisect_right(borders, word[::-1])


def open_borders(words: list[tuple[bytes, int]], classes: int) -> list[bytes]:
    """Reversed spellings that cut the words into intervals of about equal counts."""
    ranked = sorted((w[::-1], c) for w, c in words)
    total, out, held = sum(c for _, c in words), [], 0
    for w, c in ranked:
        if held * classes >= total * (len(out) + 1):
            out.append(w)
        held += c
    return out[: classes - 1]


def build_lexicon(top: list[tuple[bytes, int]], total: int, distinct: int, sums, short_list: int = SHORT_LIST, classes: int = SHORT_CLASSES, open_classes: int = OPEN_CLASSES) -> Lexicon:
    """From the known words and ``sums(borders)``: counts and words by open class, of all words."""
    ranked = sorted(top, key=lambda x: (-x[1], x[0]))
    listed, others = ranked[:short_list], ranked[short_list:]
    # classes of about equal root mass, the frequent words first
    mass = np.sqrt(np.array([c for _, c in listed], float))
    share = (np.cumsum(mass) - mass) / max(mass.sum(), 1e-9)
    group = np.minimum((share * classes).astype(int), classes - 1)
    starts = np.searchsorted(group, np.arange(classes + 1))
    borders = open_borders(others, open_classes)
    n, v = (np.zeros(len(borders) + 1) for _ in range(2))
    for f, (t, d) in sums(borders).items():
        n[f], v[f] = t, d
    for w, c in listed:
        f = open_class(w, borders)
        n[f] -= c
        v[f] -= 1
    cls = np.concatenate([group, classes + np.array([open_class(w, borders) for w, _ in others], np.int64)]).astype(np.int64)
    words = {w: i for i, (w, _) in enumerate(ranked)}
    # an empty lexicon still has a number to look up
    counts = np.array([c for _, c in ranked] or [0], float)
    return Lexicon(words, counts, cls if len(cls) else np.zeros(1, np.int64), starts, borders, total, distinct, n, v)


def _log_softmax(s: np.ndarray, m: np.ndarray, at: np.ndarray):
    """(log probability of column ``at`` by row, unscaled probabilities, a function that
    turns these in place into the gradients of the log probability by the products)."""
    e = s @ m
    rows = np.arange(len(s))
    picked = e[rows, at]
    with np.errstate(over="ignore"):
        total = np.exp(e, out=e).sum(axis=1)
    if not np.isfinite(total).all():
        e = s @ m
        top = e.max(axis=1, keepdims=True)
        e -= top
        picked = e[rows, at]
        total = np.exp(e, out=e).sum(axis=1)

    def slope(e: np.ndarray) -> np.ndarray:
        e /= -total[:, None]
        e[rows, at] += 1
        return e

    return picked - np.log(total), e, slope


class GatedNetwork:
    """h' = z h + (1 - z) n; the state before a token predicts it."""

    def __init__(self, lexicon: Lexicon, hidden: int = HIDDEN, seed: int = 1, kind=np.float32):
        rng = np.random.default_rng(seed)
        k, m, listed = lexicon.short_classes, len(lexicon.borders) + 1, lexicon.listed
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(kind)
        mass = np.array([lexicon.counts[a:b].sum() for a, b in zip(lexicon.starts, lexicon.starts[1:], strict=False)] + lexicon.open_total.tolist())
        bias, words = np.log(mass + 1.0), np.log(lexicon.counts[:listed] + 0.5)
        for a, b in zip(lexicon.starts, lexicon.starts[1:], strict=False):
            if b > a:
                words[a:b] -= words[a:b].max()
        self.p = {"x": small(listed + m, 2 * hidden), "c": small(hidden, k + m), "cb": (bias - bias.max()).astype(kind), "w": small(hidden, listed), "wb": words.astype(kind)}
        # units remember over spans from a word to some sixty
        self.p["x"][:, :hidden] += np.linspace(-1, 4, hidden).astype(kind)
        self.p["x"][:, hidden:] *= 5
        self.hidden, self.starts, self.kind = hidden, lexicon.starts, kind
        self.g2 = {n: np.full_like(v, 1e-6) for n, v in self.p.items()}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Gate and candidate of every input row."""
        d = self.hidden
        return 0.5 + 0.5 * np.tanh(0.5 * self.p["x"][:, :d]), np.tanh(self.p["x"][:, d:])

    def states(self, x: np.ndarray, fresh: np.ndarray, carry: np.ndarray, tables, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """States before every token of consecutive tokens, and the state after them.

        Windows are run side by side from nothing, with the product of their gates; the
        state that really enters each one is then carried through them in order.
        """
        z, n = tables
        take = (1 - z) * n
        count, size = -(-len(x) // window), len(x)
        before = np.zeros(count * window, np.int64)
        before[1:size] = x[:-1]
        stop = np.zeros(count * window, bool)
        stop[:size] = fresh
        before, stop = before.reshape(count, window).T, stop.reshape(count, window).T
        gate, state = z[before], take[before]
        gate[stop], state[stop] = 0, 0
        if not fresh[0]:
            gate[0, 0], state[0, 0] = 1, 0
        for t in range(1, window):
            state[t] += gate[t] * state[t - 1]
            gate[t] *= gate[t - 1]
        enter = np.empty((count, self.hidden), self.kind)
        h = carry
        for i in range(count):
            enter[i] = h
            h = gate[-1, i] * h + state[-1, i]
        state += gate * enter
        flat = state.transpose(1, 0, 2).reshape(-1, self.hidden)[:size]
        return flat, z[x[-1]] * flat[-1] + take[x[-1]]

    def log_probs(self, states: np.ndarray, cls: np.ndarray, numbers: np.ndarray, grad: bool = False):
        """Natural log of P(class) P(word | class); of open classes the class only."""
        p, d = self.p, self.hidden
        # a column of ones: the products take the biases along, and give their gradients
        ones = np.ones((len(states), d + 1), states.dtype)
        ones[:, :d] = states
        of_class, of_word = np.vstack([p["c"], p["cb"]]), np.vstack([p["w"], p["wb"]])
        out, e, picked = _log_softmax(ones, of_class, cls)
        if grad:
            g_class, g_word = ones.T @ picked(e), np.zeros_like(of_word)
            ds = e @ p["c"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(len(self.starts)))
        for k in range(len(self.starts) - 1):
            pick, a, b = order[bounds[k] : bounds[k + 1]], self.starts[k], self.starts[k + 1]
            if not len(pick):
                continue
            s = ones[pick]
            lp, e, picked = _log_softmax(s, of_word[:, a:b], numbers[pick] - a)
            out[pick] += lp
            if grad:
                g_word[:, a:b] = s.T @ picked(e)
                ds[pick] += e @ p["w"][:, a:b].T
        if not grad:
            return out
        return out, ds, {"c": g_class[:d], "cb": g_class[d], "w": g_word[:d], "wb": g_word[d]}

    def gradients(self, before: np.ndarray, stop: np.ndarray, cls: np.ndarray, numbers: np.ndarray, live: np.ndarray, enter: np.ndarray):
        """(log likelihood, gradients, states) of one window of all streams.

        [step, stream]: ``before`` the input row of the token before, ``stop`` whether a
        text begins; ``enter`` the states that the windows before ended in.
        """
        d = self.hidden
        z, n = self.tables()
        gate, states = z[before], ((1 - z) * n)[before]
        gate[stop], states[stop] = 0, 0
        states[0] += gate[0] * enter
        for t in range(1, len(before)):
            states[t] += gate[t] * states[t - 1]
        on = live.reshape(-1)
        out, ds, g = self.log_probs(states.reshape(-1, d)[on], cls.reshape(-1)[on], numbers.reshape(-1)[on], True)
        back = np.zeros((len(on), d), self.kind)
        back[on] = ds
        back = back.reshape(states.shape)
        for t in range(len(before) - 1, 0, -1):
            back[t - 1] += gate[t] * back[t]
        earlier = np.concatenate([enter[None], states[:-1]])
        both = np.concatenate([back * earlier, back], axis=2)
        both[stop] = 0
        rows = before.reshape(-1)
        order = np.argsort(rows.astype(np.int16 if len(z) < 1 << 15 else np.int32), kind="stable")
        ranked = rows[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        used = ranked[first]
        sums = np.add.reduceat(both.reshape(-1, 2 * d)[order], first, axis=0)
        zu, nu = z[used], n[used]
        of_gate, of_state = sums[:, :d], sums[:, d:]
        g["x"] = np.concatenate([(of_gate - of_state * nu) * zu * (1 - zu), of_state * (1 - zu) * (1 - nu * nu)], axis=1)
        return float(out.sum()), g, used, states

    def step(self, g: dict[str, np.ndarray], used: np.ndarray, tokens: int, rate: float) -> None:
        """One step up the likelihood, scaled by the root of the running squares."""
        scale = 100.0 / max(1, tokens)
        for name, grad in g.items():
            at = used if name == "x" else slice(None)
            grad = np.clip(grad * self.kind(scale), -5, 5)
            mean = self.g2[name][at]
            mean += 0.05 * (grad * grad - mean)
            self.g2[name][at] = mean
            self.p[name][at] += self.kind(rate) * grad / (np.sqrt(mean) + self.kind(1e-3))


def flatten(lexicon: Lexicon, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Numbers, classes, inputs and text starts of all tokens of some texts, in order."""
    lengths = np.array([len(t) for t in texts])
    numbers = lexicon.numbers([w for t in texts for w in t])
    classes = lexicon.classes(numbers)
    fresh = np.zeros(len(numbers), bool)
    fresh[np.cumsum(lengths) - lengths] = True
    return numbers, classes, lexicon.inputs(numbers, classes), fresh


def train_on(network: GatedNetwork, lexicon: Lexicon, texts: list[list[bytes]], rate: float, streams: int = STREAMS, window: int = WINDOW) -> int:
    """Steps on texts laid end to end and cut into streams; returns the tokens."""
    numbers, classes, inputs, fresh = flatten(lexicon, texts)
    size = len(numbers)
    length = -(-size // streams)
    live = np.arange(length * streams) < size

    def lay(a: np.ndarray) -> np.ndarray:
        return np.concatenate([a, np.zeros(length * streams - size, a.dtype)]).reshape(streams, length).T

    before = lay(np.concatenate([[0], inputs[:-1]]))
    stop, cls, num, live = lay(fresh).copy(), lay(classes), lay(numbers), live.reshape(streams, length).T
    stop[0] = True
    enter = np.zeros((streams, network.hidden), network.kind)
    for a in range(0, length, window):
        b = min(length, a + window)
        if not live[a:b].any():
            break
        _, g, used, states = network.gradients(before[a:b], stop[a:b], cls[a:b], num[a:b], live[a:b], enter)
        enter = states[-1]
        network.step(g, used, int(live[a:b].sum()), rate)
    return size


def score_texts(network: GatedNetwork, lexicon: Lexicon, flat: tuple[np.ndarray, ...], block: int = BLOCK) -> np.ndarray:
    """log10 of the network's part of each text's probability; ``flat`` is of :func:`flatten`."""
    numbers, classes, inputs, fresh = flat
    owner = np.cumsum(fresh) - 1
    tables, carry = network.tables(), np.zeros(network.hidden, network.kind)
    out = np.zeros(int(fresh.sum()))
    for a in range(0, len(numbers), block):
        at = slice(a, a + block)
        states, carry = network.states(inputs[at], fresh[at], carry, tables)
        lp = network.log_probs(states, classes[at], numbers[at])
        out += np.bincount(owner[at], weights=lp, minlength=len(out))
    return out / np.log(10)


# -- the Spark operator ------------------------------------------------------------
def _batches_of_texts(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    keys, texts, held = [], [], 0
    for piece in slices(batches, limit=1 << 20):
        for k, t in zip(piece.column("key").to_pylist(), piece.column("text").to_pylist(), strict=True):
            w = tokens_of(t)
            if texts and held + len(w) > tokens:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(k)
            texts.append(w)
            held += len(w)
    if texts:
        yield keys, texts


def learn_lexicon(counts: DataFrame, known: int = KNOWN_WORDS, short_list: int = SHORT_LIST, classes: int = SHORT_CLASSES) -> Lexicon:
    """Totals over all words and the ``known`` most frequent words (ties by bytes)."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = [(bytes(r["word"]), r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(known).collect()]

    def sums(borders: list[bytes]) -> dict[int, tuple[int, int]]:
        def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, v = [0] * (len(borders) + 1), [0] * (len(borders) + 1)
            for b in batches:
                for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True):
                    f = open_class(w, borders)
                    n[f] += c
                    v[f] += 1
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64()), pa.array(v, pa.int64())], ["open", "n", "v"])

        found = counts.mapInArrow(by_class, "open int, n long, v long").groupBy("open").agg(F.sum("n"), F.sum("v")).collect()
        return {r[0]: (r[1], r[2]) for r in found}

    return build_lexicon(top, total[0], total[1], sums, short_list, classes)


def part_of_round(train: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """Rows (key, text) of round ``k``, dealt by key and text: every row is in one round."""
    return train.where(F.pmod(F.xxhash64("key", "text"), F.lit(rounds)) == k)


def _sum_parts(parts: DataFrame, *by: str) -> DataFrame:
    """Rows (part, grp, n, sums) added up by ``by``, a stream of rows at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            for part, grp, n, data in zip(*(b.column(c).to_pylist() for c in ("part", "grp", "n", "sums")), strict=True):
                v = np.frombuffer(data, np.float32).astype(np.float64)
                own = held.setdefault((part, grp if "grp" in by else 0), [0.0, 0.0])
                own[0], own[1] = own[0] + n, own[1] + v
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.float64()), pa.array([held[k][1].astype(np.float32).tobytes() for k in keys], pa.binary())], ["part", "grp", "n", "sums"])

    return parts.repartition(*(F.col(c) for c in by)).mapInArrow(add, "part int, grp int, n double, sums binary")


def train_network(train: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, rate: float = 0.02) -> GatedNetwork:
    """Rounds of local steps with averaging over all training texts.

    Each round takes its own part of the texts.  Every partition starts from the round's
    parameters and returns its own, weighted by tokens and cut into parts.  The parts are
    added up in groups of partitions and then over the groups, each in a task of its own,
    so no task and not the driver sees the parameters of all partitions.
    """
    spark = train.sparkSession
    network = GatedNetwork(lexicon)
    for k in range(rounds):
        part = part_of_round(train, k, rounds).select(F.lit(0).alias("key"), "text")
        shared = spark.sparkContext.broadcast(pickle.dumps((network.p, lexicon)))
        pace = rate / (1 + k)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, pace=pace) -> Iterator[pa.RecordBatch]:
            start, lex = pickle.loads(shared.value)
            net, n = GatedNetwork(lex), 0
            net.p = start
            gc.disable()
            try:
                for _, texts in _batches_of_texts(batches, 400_000):
                    n += train_on(net, lex, texts, pace)
            finally:
                gc.enable()
            if n:
                flat = np.concatenate([net.p[name].reshape(-1) for name in sorted(net.p)]) * np.float32(n)
                cut = np.array_split(flat, PARTS)
                group = TaskContext.get().partitionId() % FAN_IN
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array([float(n)] * PARTS), pa.array([c.tobytes() for c in cut], pa.binary())], ["part", "grp", "n", "sums"])

        local = part.mapInArrow(run, "part int, grp int, n double, sums binary")
        total = _sum_parts(_sum_parts(local, "part", "grp"), "part").collect()
        if not total:
            continue
        mean, at = np.concatenate([np.frombuffer(r["sums"], np.float32) / np.float32(r["n"]) for r in sorted(total, key=lambda r: r["part"])]), 0
        for name in sorted(network.p):
            size = network.p[name].size
            network.p[name] = mean[at : at + size].reshape(network.p[name].shape)
            at += size
    return network


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score whole texts; learn from the rows where ``train`` (of the key) holds.

    Returns key, n_tokens, n_known, train_tokens (long), base_score, score.  A null text
    counts as empty: it has the end token only.  Without training rows every count is
    zero and both scores are those of unseen tokens.  Repeated rows and null keys are
    kept, each row scored on its own.

    The counts of the most frequent words travel with the network; every other word of
    a text is looked up by a join on the word, added up per text.  No such word is
    frequent, so no key of the join is hot.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), train.alias("train"))
    fit = rows.where("train")
    counts = durable(count_words(fit), "word-counts")
    lexicon = learn_lexicon(counts)
    network = train_network(fit, lexicon)
    shared = spark.sparkContext.broadcast(pickle.dumps((network.p, lexicon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, lex = pickle.loads(shared.value)
        net = GatedNetwork(lex)
        net.p = params
        below, value = lex.open_denominators(), np.log10(lex.counts + 1.0)
        gc.disable()
        try:
            for keys, texts in _batches_of_texts(batches, 200_000):
                flat = flatten(lex, texts)
                numbers, classes, _, fresh = flat
                owner = np.cumsum(fresh) - 1
                add = lambda w: np.bincount(owner, weights=w, minlength=len(texts))  # noqa: B023, E731
                known = numbers >= 0
                part = np.where(known, value[numbers], 0.0)
                is_open = classes >= lex.short_classes
                scores = score_texts(net, lex, flat) + add(np.where(is_open, part - below[np.where(is_open, classes - lex.short_classes, 0)], 0.0))
                tokens = np.bincount(owner, minlength=len(texts))
                # the words that aren't known, counted text by text
                words, counts, ends, miss = [], [], [0], np.flatnonzero(~known)
                begin = np.cumsum(tokens) - tokens
                cuts = np.searchsorted(miss, np.append(begin, len(numbers))).tolist()
                places = (miss - begin[owner[miss]]).tolist()
                for i, t in enumerate(texts):
                    if cuts[i] < cuts[i + 1]:
                        tally = Counter(map(t.__getitem__, places[cuts[i] : cuts[i + 1]]))
                        words += tally.keys()
                        counts += tally.values()
                    ends.append(len(words))
                rest = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, key_type), pa.array(tokens, pa.int64()), pa.array(add(known).astype(np.int64)), pa.array(add(part) - tokens * lex.base_denominator), pa.array(scores), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)],
                    ["key", "n_tokens", "n_known", "base", "net", "rest"],
                )
        finally:
            gc.enable()

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(rows.schema["key"].dataType)
    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.select("key", "text").mapInArrow(run, f"key {kind}, n_tokens long, n_known long, base double, net double, rest array<struct<word:binary,n:long>>")
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()), "network-scores")
    unknown = scored.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    found = unknown.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("part"))
    part = F.coalesce("part", F.lit(0.0))
    return scored.drop("rest").join(found, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("base") + part).alias("base_score"), (F.col("net") + part).alias("score")
    )
