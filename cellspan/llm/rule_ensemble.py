"""Quality classifier: a sparse ensemble of tree rules under a lasso logistic model.

Statistics of whole texts are measured once per row.  Small trees are grown on
bootstrap samples of labelled statistics; each path from a root is a conjunctive
rule.  Rules are weighted by an L1-penalised logistic regression, most get weight
zero, and the rest are compiled into one Spark column expression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, settle, slices

#: Labelled rows that the ensemble is fitted on at most, the first by hash of the key.
MAX_TRAIN_ROWS = 20_000
STATS = ("log_words", "word_chars", "upper_share", "digit_share", "symbol_share", "punct_share", "bang_share", "bar_share", "distinct_words", "distinct_lines", "top_word", "line_words", "other_share")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>@^~=+_\\{}[]"
_PUNCT = b".,;:?\"'()-"
_CHUNK = 1 << 20


def text_statistics(text: str | None) -> list[float]:
    """The values of ``STATS`` for a whole text; a null or empty text gives zeros."""
    if not text:
        return [0.0] * len(STATS)
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    count = lambda chars: n - len(data.translate(None, chars))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = len(words)
    spaces = n - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    top = 0
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = c = tally.get(w, 0) + 1
        if c > top:
            top = c
    solid = max(1, n - spaces)
    other = sum(1 for c in text if not (c.isascii() or c.isalpha())) if not text.isascii() else 0
    return [
        float(np.log1p(k)), solid / max(1, k), count(_UPPER) / solid, count(_DIGIT) / solid, count(_SYMBOL) / solid, count(_PUNCT) / solid, data.count(b"!") / solid, data.count(b"|") / solid,
        len(tally) / max(1, k), len(set(lines)) / max(1, len(lines)), top / max(1, k), k / max(1, len(lines)) / (1 + k / max(1, len(lines))), other / len(text),
    ]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``keep`` columns, key and the statistics ``s_<name>`` of the whole text."""
    names = ["key", *(f"k_{c}" for c in keep)]
    rows = docs.select(F.col(key).alias("key"), *(F.col(c).alias(f"k_{c}") for c in keep), F.col(text).cast("string").alias("stat_text"))
    kinds = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "stat_text"):
            got = np.array([text_statistics(t) for t in piece.column("stat_text").to_pylist()], dtype=np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *(pa.array(got[:, j]) for j in range(len(STATS)))], [*names, *(f"s_{s}" for s in STATS)])

    out = rows.mapInArrow(run, ", ".join([*kinds, *(f"s_{s} double" for s in STATS)]))
    return out.withColumnsRenamed({"key": key} | {f"k_{c}": c for c in keep})


# -- rules ---------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, cut): ``x > cut`` if above else ``x <= cut``."""

    terms: tuple[tuple[int, bool, float], ...]

    def values(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for j, above, cut in self.terms:
            ok &= (x[:, j] > cut) if above else (x[:, j] <= cut)
        return ok


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _sum(parts: list[str]) -> str:
    """A balanced sum: its depth grows with the logarithm of the number of terms."""
    while len(parts) > 1:
        parts = [f"({' + '.join(parts[i : i + 2])})" for i in range(0, len(parts), 2)]
    return parts[0]


def _compiled(rules: list[tuple[tuple, float]]) -> str:
    """SQL of the weights of all conjunctions that hold; what conjunctions begin with in
    common is tested once.  A null statistic fulfils nothing."""
    own, below = sum(w for terms, w in rules if not terms), {}
    for terms, w in rules:
        if terms:
            below.setdefault(terms[0], []).append((terms[1:], w))
    tests = [f"IF(s_{STATS[j]} {'>' if above else '<='} {_number(cut)}, {_compiled(rest)}, 0D)" for (j, above, cut), rest in below.items()]
    return _sum([_number(float(own)), *tests] if own or not tests else tests)


def tree_rules(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, depth: int = 3, bins: int = 24, least: int = 10) -> list[Rule]:
    """Paths of a regression tree on ``target``, over a random half of the statistics a node."""
    rules: list[Rule] = []

    def grow(rows: np.ndarray, terms: tuple, left: int) -> None:
        if terms:
            rules.append(Rule(terms))
        if not left or len(rows) < 2 * least:
            return
        y, best = target[rows], (1e-9, None)
        total = y.sum()
        for j in rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            sums = np.cumsum(y[order])
            at = np.unique(np.linspace(least, len(rows) - least, bins).astype(int)) - 1
            at = at[v[order[at]] < v[order[at + 1]]]
            if not len(at):
                continue
            n = at + 1
            gain = sums[at] ** 2 / n + (total - sums[at]) ** 2 / (len(rows) - n) - total**2 / len(rows)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = gain[k], (int(j), float((v[order[at[k]]] + v[order[at[k] + 1]]) / 2))
        if best[1]:
            j, cut = best[1]
            above = x[rows, j] > cut
            grow(rows[above], (*terms, (j, True, cut)), left - 1)
            grow(rows[~above], (*terms, (j, False, cut)), left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules


def lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the weighted logistic loss with an L1 penalty."""
    n, p = z.shape
    z, share = z.astype(np.float32, copy=False), (weight / weight.sum()).astype(np.float32)
    b, w = 0.0, np.zeros(p)
    vb, v, t = b, w.copy(), 1.0
    # the largest curvature from the p x p products; the rows are never copied
    gram = np.zeros((p + 1, p + 1))
    for i in range(0, n, 1024):
        part, at = z[i : i + 1024], share[i : i + 1024]
        gram[:p, :p] += (part * at[:, None]).T @ part
        gram[:p, p] += part.T @ at
    gram[p, :p], gram[p, p] = gram[:p, p], 1.0
    rate = 4.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-9)
    for _ in range(steps):
        g = share * (1 / (1 + np.exp(-np.clip(z @ v.astype(np.float32) + vb, -30, 30))) - y).astype(np.float32)
        nb, nw = vb - rate * float(g.sum(dtype=np.float64)), v - rate * (g @ z)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, v = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w


@dataclass(frozen=True)
class RuleEnsemble:
    """Intercept and weighted rules; ``score()`` is the Spark expression of the model."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            out += w * rule.values(x)
        return out

    def score(self) -> Column:
        return F.expr(f"1D / (1D + exp(-{_compiled([((), self.intercept), *((rule.terms, w) for rule, w in self.rules)])}))")


def fit_ensemble(x: np.ndarray, y: np.ndarray, trees: int = 40, penalty: float = 2e-3, seed: int = 7) -> RuleEnsemble:
    """Grow trees on residuals of bootstrap samples, then weigh their rules.

    With no rows the score is 0.5 everywhere; with one class only, its smoothed share.
    """
    n, ones = len(y), float(y.sum())
    prior = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else 0.0
    if not n or ones in (0.0, float(n)):
        return RuleEnsemble(prior, ())
    rng, total, found = np.random.default_rng(seed), np.full(n, prior), {}
    for _ in range(trees):
        pick = rng.choice(n, min(n, max(50, n // 2)), replace=True)
        residual = y - 1 / (1 + np.exp(-total))
        grown = tree_rules(x[pick], residual[pick], rng)
        for rule in grown:
            ok = rule.values(x)
            if 0 < ok.sum() < n:
                found.setdefault(ok.tobytes(), rule)
        # a cautious step towards the leaves keeps later trees different
        leaves = [r for r in grown if not any(o is not r and o.terms[: len(r.terms)] == r.terms for o in grown)]
        for rule in leaves:
            ok = rule.values(x)
            if ok.any():
                total[ok] += 0.5 * np.clip(residual[ok].mean() * 4, -2, 2)
    rules = list(found.values())
    if not rules:
        return RuleEnsemble(prior, ())
    z = np.empty((n, len(rules)), np.float32)
    for i, rule in enumerate(rules):
        z[:, i] = rule.values(x)
    mean = z.mean(axis=0, dtype=np.float64)
    scale = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    z -= mean.astype(np.float32)
    z /= scale.astype(np.float32)
    b, w = lasso_logistic(z, y, np.ones(n), penalty)
    w = w / scale
    kept = [(r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-6]
    return RuleEnsemble(b - float(mean @ w), tuple(kept))


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """lab_key, lab_y of at most ``max_rows`` labelled keys of ``docs``, the first by hash.

    The labelled keys are counted first; a hash threshold from that count lets some more
    than ``max_rows`` of them through, so that ordering them moves a bounded number.
    The sample does not depend on partitioning.  Several labels of one key count as
    their rounded mean; null labels and null keys are not learnt from.
    """
    marks = labels.where(train).select(F.col(key).alias("lab_key"), F.col(label).cast("double").alias("lab_y")).where("lab_key is not null and lab_y is not null")
    marks = marks.groupBy("lab_key").agg((F.avg("lab_y") >= 0.5).cast("double").alias("lab_y"))
    marks = durable(marks.join(docs.select(F.col(key).alias("lab_key")).distinct(), "lab_key", "left_semi"), "labelled-keys")
    order = F.xxhash64(F.col("lab_key").cast("string"))
    share = min(1.0, (1.1 * max_rows + 1000) / max(1, marks.count()))
    few = marks.where(F.pmod(order, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return few.orderBy(F.pmod(order, F.lit(1 << 30)), "lab_key").limit(max_rows)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ensemble of all rows (label, statistics) as rows (feature, above, cut, weight):
    one a rule, and the intercept as the rule without tests."""
    parts = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(STATS) + 1)], axis=1) for b in batches if b.num_rows]
    data = np.concatenate([np.zeros((0, len(STATS) + 1)), *parts])
    model = fit_ensemble(data[:, 1:], data[:, 0])
    rows = [(Rule(()), model.intercept), *model.rules]
    split = [[[t[i] for t in rule.terms] for rule, _ in rows] for i in range(3)]
    kinds = (pa.int32(), pa.bool_(), pa.float64())
    columns = [*(pa.array(v, pa.list_(k)) for v, k in zip(split, kinds, strict=True)), pa.array([w for _, w in rows], pa.float64())]
    yield pa.RecordBatch.from_arrays(columns, ["feature", "above", "cut", "weight"])
    give_back()


def learn_quality(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> RuleEnsemble:
    """Fit on the whole texts of a bounded sample of labelled keys.

    Only texts of sampled keys are measured.  Of the rows of a repeated key the one with
    the smallest statistics counts, so a key is one row however many copies it has.  One
    task fits the at most ``max_rows`` rows of numbers; only the rules reach the driver.
    """
    few = durable(labelled_sample(docs, labels, train, key, label, max_rows), "labelled-sample")
    texts = docs.select(F.col(key).alias("lab_key"), F.col(text).alias("lab_text")).join(F.broadcast(few.select("lab_key")), "lab_key", "left_semi")
    values = F.struct(*(F.col(f"s_{s}") for s in STATS))
    measured = measure(texts, "lab_key", "lab_text").groupBy("lab_key").agg(F.min(values).alias("v"))
    picked = measured.join(F.broadcast(few), "lab_key").repartition(1).sortWithinPartitions("lab_key").select("lab_y", "v.*")
    found = picked.mapInArrow(_fit, "feature array<int>, above array<boolean>, cut array<double>, weight double").collect()
    rules = [(Rule(tuple(zip(r["feature"], r["above"], r["cut"], strict=True))), r["weight"]) for r in found]
    return RuleEnsemble(sum(w for rule, w in rules if not rule.terms), tuple((rule, w) for rule, w in rules if rule.terms))


def crc_mod_py(key: str, n: int) -> int:
    return zlib.crc32(key.encode()) % n


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every row; learn from labelled rows where ``train`` (of the key) holds.

    Returns key, ``keep``, the statistics and ``score``.  Null and empty texts are
    scored like any other (all statistics are zero).  Scoring is one pass over the
    texts; the learner reads those of its bounded sample only, and nothing of the
    documents is written in between.
    """
    model = learn_quality(docs, labels, train, key, text, label)
    settle(docs.sparkSession)  # the rules are a large expression
    return measure(docs, key, text, keep).withColumn("score", model.score())
