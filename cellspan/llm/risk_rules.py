"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Counts per text come from array functions on its words and lines.  The rates that are
high in poor text each have a fixed grid of cutoffs.  What is certified is the whole
verdict of a stratum: all rules together falsely reject at most ``risk`` of its good
documents.  Every rule has an equal share of that rate, and of the level, which is also
divided by the strata.  Of one rule and stratum the cutoffs are tested from the loosest
down, each at the full level, up to the first whose exact binomial tail is too large
(fixed-sequence testing): the last one that passes is applied; a rule without one is off
in that stratum.  By the union bound all verdicts of all strata keep their rate at once
with a probability of 1 - level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Strata whose cutoffs are broadcast at most (under 100 bytes each).
MAX_STRATA = 100_000
SPACES = " \\x09-\\x0D"
#: Rates that rules bound, each with its fixed grid of cutoffs.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_rate": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "upper_rate": (0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "dup_line_rate": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "repeat_rate": (0.05, 0.1, 0.15, 0.2, 0.25),
}


@dataclass(frozen=True)
class Risk:
    """False rejections allowed among the good documents of a stratum, by all rules
    together, and the probability that any stratum has more."""

    rate: float = 0.01
    level: float = 0.05


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the optimizer does."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column, window: int) -> Column:
    """Words inside windows that occur at least twice in the array."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.array_sort(
                F.transform(
                    F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]).eqNullSafe(True) | (F.get(s, i + 1)["h"] == e["h"]).eqNullSafe(True)),
                    lambda e: e["i"],
                )
            )

        def length(at: Column) -> Column:
            gaps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(window)), F.lit(window)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return _let(_let(order, twice), length)

    dup = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n <= window, F.lit(0).cast("long")).otherwise(dup)


def measure_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), window: int = 8) -> DataFrame:
    """Counts of whole texts: key, ``keep``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_upper (all long).  A null text has none of anything."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, f"[{SPACES}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.ltrim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)

    upper = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))

    def counts(w: Column) -> Column:
        chars = F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
        of_lines = _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all")))
        return _let(of_lines, lambda x: F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), symbols.cast("long").alias("n_symbols"), x["dup"].alias("n_dup_lines"), _repeated(w, window).alias("n_repeat_words"), upper.cast("long").alias("n_upper"), x["all"].alias("n_lines")))

    # a generator of one row: no later filter or projection counts anything again
    return docs.select(F.col(key), *(F.col(c) for c in keep), F.inline(F.array(_let(words, counts))))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rates() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {"symbol_rate": per("n_symbols", "n_words"), "upper_rate": per("n_upper", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words")}


# -- exact binomial tail ---------------------------------------------------------
def _log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1: Stirling's series at x + 8, carried back by the recurrence."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, summed down from k.

    Below the mean the summands fall at least as fast as a normal density does, so those
    beyond ten standard deviations from k are under 1e-20 of the sum, whatever n is; a
    geometric majorant stands for them.  A null count gives null.
    """
    k, n = k.cast("double"), n.cast("double")
    log_top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    far = F.ceil(10 * F.sqrt(n * (p * (1 - p)))) + 60
    steps = F.sequence(F.lit(0), F.least(k, far.cast("double")).cast("int"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("term"))

    done = F.aggregate(steps, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")), add)
    ratio = F.least((k + 1) * (1 - p) / (F.greatest(n - k, F.lit(1.0)) * p), F.lit(0.999999))
    return F.least(F.lit(1.0), F.exp(log_top) * _let(done, lambda d: d["sum"] + d["term"] / (1 - ratio)))


def good_keys(labels: DataFrame, key: str, label: str) -> DataFrame:
    """lab_key: distinct keys whose labels are good on average."""
    marks = labels.select(F.col(key).alias("lab_key"), F.col(label).cast("double").alias("lab_y")).where("lab_key is not null and lab_y is not null")
    return marks.groupBy("lab_key").agg(F.avg("lab_y").alias("lab_y")).where("lab_y >= 0.5").select("lab_key")


def certified_cutoffs(measured: DataFrame, labels: DataFrame, key: str, stratum: str, label: str = "quality", risk: Risk = Risk(), grids: dict[str, tuple[float, ...]] = GRIDS) -> DataFrame:
    """stratum, rule, cutoff: the lowest certified cutoff of each rule and stratum.

    Good documents are labelled keys with rows that pass the base rules.  A key is one
    trial in a stratum, however many rows it has: it counts as rejected if any of them is.
    Counting is one partial aggregation by stratum; a hot stratum is summed before it
    moves.  Several labels of a key count as their rounded mean; null labels and null keys
    are left out; a null stratum is a stratum of its own.
    """
    rate = rates()
    able = measured.where(~base_failed()).select(F.col(key).alias("lab_key"), F.col(stratum).alias("stratum"), *(rate[r].alias(r) for r in grids))
    good = able.join(good_keys(labels, key, label), "lab_key", "left_semi").groupBy("lab_key", "stratum").agg(*(F.max(r).alias(r) for r in grids))
    cells = [(r, c) for r, grid in grids.items() for c in grid]
    sums = durable(good.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum((F.col(r) > c).cast("long")).alias(f"c{i}") for i, (r, c) in enumerate(cells))), "rule-sums")
    strata = max(1, sums.count())
    tests = F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"c{i}").alias("k")) for i, (r, c) in enumerate(cells))))
    table = sums.select("stratum", "n", tests)
    allowed = risk.rate / len(grids)
    # rejections only grow as a cutoff falls, so the cutoffs that pass are those before the
    # first that fails
    ok = (F.col("k") < F.col("n") * allowed) & (binomial_tail(F.col("k"), F.col("n"), allowed) <= risk.level / (strata * len(grids)))
    return table.where(ok).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", keep: tuple[str, ...] = (), risk: Risk = Risk()) -> DataFrame:
    """Counts, ``base_failed``, ``failed_rules`` (names) and ``kept`` of every row.

    Without ``keep``, texts are measured once into a table of counts that the thresholds
    and the verdicts share.  With ``keep``, the table would hold copies of the rows: the
    counts are taken twice instead, for the thresholds and for the verdicts, and nothing of
    the documents is written or moved.  The certified cutoffs are pivoted to one row
    a stratum before the join, so the join never multiplies rows.
    """
    columns = tuple(dict.fromkeys((stratum, *keep)))
    if keep:
        measured = measure_rules(docs, key, text, columns)
        learn = measure_rules(docs, key, text, (stratum,))
    else:
        measured = learn = durable(measure_rules(docs, key, text, columns), "rule-counts")
    cut = certified_cutoffs(learn, labels, key, stratum, risk=risk)
    wide = durable(cut.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRIDS)), "cutoffs")
    rate = rates()
    # one row a stratum: sent to all tasks as long as the counted rows allow it
    few = F.broadcast(wide) if wide.count() <= MAX_STRATA else wide
    joined = measured.join(few, measured[stratum].eqNullSafe(wide["stratum"]), "left")
    failed = F.filter(F.array(*(F.when(rate[r] > F.col(f"cut_{r}"), F.lit(r)) for r in GRIDS)), lambda x: x.isNotNull())
    out = joined.select(*measured.columns, base_failed().alias("base_failed"), failed.alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
