"""The whole pipeline and the risk rules against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellspan.llm import queries, risk_rules, rule_ensemble
from cellspan.llm.common import read_table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def tail(k, n, p):
    """P(Binomial(n, p) <= k), term by term."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)


def counts(text):
    w = WORD.findall(text or "")
    spots = {}
    for s in range(len(w) - 7):
        spots.setdefault(tuple(w[s : s + 8]), []).append(s)
    rep = {p + j for v in spots.values() if len(v) > 1 for p in v for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(rep), "n_upper": len(re.findall("[A-Z]", text or ""))}


def rates(c):
    per = lambda a, b: c[a] / c[b] if c[b] else 0.0
    return {"symbol_rate": per("n_symbols", "n_words"), "upper_rate": per("n_upper", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words")}


def base_failed(c):
    return c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]


def plain_cutoffs(rows, good, rate=0.01, level=0.05):
    """rows: (key, stratum, counts).  {(stratum, rule): cutoff} by walking every grid down."""
    worst = {}
    for key, stratum, c in rows:
        if key in good and not base_failed(c):
            old = worst.setdefault((stratum, key), dict.fromkeys(risk_rules.GRIDS, 0.0))
            for r, v in rates(c).items():
                old[r] = max(old[r], v)
    strata = {s for s, _ in worst}
    out = {}
    for s in strata:
        mine = [v for (t, _), v in worst.items() if t == s]
        for rule, grid in risk_rules.GRIDS.items():
            for cut in sorted(grid, reverse=True):
                k = sum(v[rule] > cut for v in mine)
                if tail(k, len(mine), rate / 4) > level / 4 / len(strata):
                    break
                out[s, rule] = cut
    return out


def test_binomial_tail_of_large_strata(spark):
    cases = [(0, 10, 0.01), (1, 400, 0.01), (12, 2000, 0.01), (90, 10_000, 0.01), (2300, 1_000_000, 0.0025), (9800, 1_000_000, 0.01), (9999, 1_000_000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(risk_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        if k < n * p:
            assert got == pytest.approx(tail(k, n, p), rel=1e-6), (k, n)


def test_strata_keep_their_joint_rate(spark):
    rng = random.Random(11)
    chance = {r: [0.006 * (len(g) - i) / len(g) for i in range(len(g))] for r, g in risk_rules.GRIDS.items()}
    base = {"n_words": 1000, "word_chars": 1000, "n_symbols": 0, "n_dup_lines": 0, "n_lines": 1000, "n_repeat_words": 0, "n_upper": 0}
    column = {"symbol_rate": "n_symbols", "upper_rate": "n_upper", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words"}
    rows = []
    for s in range(25):
        size, scale = rng.choice([400, 2500, 4000]), rng.choice([0.1, 0.5, 1.0])
        for i in range(size):
            c = dict(base)
            for rule, grid in risk_rules.GRIDS.items():
                # the chance to be above grid[i] is scale * chance[rule][i]
                u = rng.random()
                above = sum(u < scale * x for x in chance[rule])
                if above:
                    c[column[rule]] = int(1000 * grid[above - 1]) + 1
            rows.append((s * 100_000 + i, f"s{s}", c))
        rows += [(s * 100_000, f"s{s}", base | {"n_symbols": 999})] * 40  # one key, many rows
    good = {k for k, _, _ in rows}
    names = list(base)
    measured = spark.createDataFrame([(k, s, *(c[n] for n in names)) for k, s, c in rows], "doc_id long, lang string, " + ", ".join(f"{n} long" for n in names))
    labels = spark.createDataFrame([(k, 1) for k in sorted(good)], "doc_id long, quality int")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in risk_rules.certified_cutoffs(measured, labels, "doc_id", "lang").collect()}
    assert got == plain_cutoffs(rows, good) and got
    # the share of good documents that all rules together really reject
    for s in {s for s, _ in got}:
        docs = {}
        for k, t, c in rows:
            if t == s:
                docs[k] = docs.get(k, False) or any(rates(c)[r] > got[s, r] for r in risk_rules.GRIDS if (s, r) in got)
        assert sum(docs.values()) <= 0.01 * len(docs)


def test_pipeline_matches_plain_python(spark):
    import sentencepiece

    docs = [r.asDict() for r in read_table(spark, SF, "documents").collect()]
    labels = read_table(spark, SF, "labels")
    frame = read_table(spark, SF, "documents")
    model = rule_ensemble.learn_quality(frame, labels, F.lit(True))
    import numpy as np

    scores = model.logit(np.array([rule_ensemble.text_statistics(d["text"]) for d in docs]))
    docs = [d for d, s in zip(docs, scores, strict=True) if s >= 0]
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    rows = [(d["doc_id"], d["lang"], counts(d["text"])) for d in docs]
    cut = plain_cutoffs(rows, good)
    docs = [d for d, (_, s, c) in zip(docs, rows, strict=True) if not base_failed(c) and not any(v > cut.get((s, r), 9) for r, v in rates(c).items())]

    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    sets = []
    for d in docs:
        w = WORD.findall(lower(d["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(docs)))

    def find(i):
        return i if least[i] == i else find(least[i])

    order = sorted(range(len(docs)), key=lambda i: docs[i]["doc_id"])
    for n, i in enumerate(order):
        for j in order[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda x: docs[x]["doc_id"])
                least[b] = a
    docs = [d for i, d in enumerate(docs) if find(i) == i]

    def plain(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))

    items = [plain(r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    items = [w for w in items if len(w) >= 8]

    def leaked(text):
        w, hits = plain(text), 0
        grams = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in (8, 13)}
        for item in items:
            runs = lambda n: any(tuple(item[i : i + n]) in grams[n] for i in range(len(item) - n + 1))  # noqa: B023, E731
            whole = any(w[i : i + len(item)] == item for i in range(len(w) - len(item) + 1))
            if runs(13) or whole:
                return True
            hits += runs(8)
        return hits >= 2

    docs = [d for d in docs if not leaked(d["text"])]
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = sorted((d["doc_id"], sp.encode(d["text"] or "")) for d in docs)
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(want) > 100


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, clashing names, empty tables; texts are whole."""
    text = " ".join(f"word{i} and more of it" for i in range(30))
    rows = [(1, text, None, None, None, 1, "k"), (1, text, None, None, None, 1, "k"), (None, text + " x", "en", "s", 3, 2, None), (2, None, None, None, None, 3, "d"), (3, "", "en", "s", 0, 4, "d"), (4, "long " * 40_000, "en", "s", 9, 5, "d")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, doc string")
    for name, stage in corpus_pipeline.STAGES:
        for docs, n in ((odd, len(rows)), (odd.limit(0), 0)):
            docs.write.mode("overwrite").parquet(f"file://{tmp_path}/docs")
            out = stage(spark, spark.read.parquet(f"file://{tmp_path}/docs"), SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            assert out.count() <= n
            if n and name == "n-gram Jaccard join":
                assert sorted((r["doc_id"] or 0 for r in out.collect())) == [1, 2, 3, 4]
            if n and name in ("benchmark decontamination", corpus_pipeline.STAGES[-1][0]):
                assert out.count() == n
