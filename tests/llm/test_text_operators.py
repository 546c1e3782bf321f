"""Text operators against brute force, libraries and round trips, edge cases included."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan.llm import chat_repair as chat
from cellspan.llm import jaccard_join as jj
from cellspan.llm import language_id, license_scan, queries, recurrent_lm, risk_rules, rule_ensemble, wordpiece_counts, wu_manber
from cellspan.llm import sentencepiece_codec as spc
from cellspan.llm.components import connected_components

ODD = [None, "", " ", "\n\n", "a", "▁x", "a▁ b", "<s> </s> <0x0A>", "  lead", "日本語 テキスト", "é́ ﬁ", "x " * 3000, "A" * 5000, "One two three four five six seven eight nine.", "One two three four five six seven eight nine."]


def frame(spark, texts, **more):
    """Rows with nulls, repeats and columns whose names clash with inner ones."""
    rows = [(i, t, "en", 1, "k", b"s") for i, t in enumerate(texts)] + [(None, "null key", None, 2, "k", b"s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, key string, sig binary")


def test_sentencepiece_matches_library(spark):
    import sentencepiece

    path = queries.tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab \n▁é日😀<>0x\x01tion") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = {r["doc_id"]: r for r in spc.encode_documents(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids, raw = sp.encode(t or ""), (t or "").encode()
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids) == spc.load_model(path).decode(ids)
        begins, ends = got[i]["begins"], got[i]["ends"]
        assert begins == sorted(begins) and ends == sorted(ends)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends, strict=True)) == raw
    assert got[None]["ids"] == sp.encode("null key")


def test_bulk_merges_equal_single_merges():
    import sentencepiece

    path = queries.tokenizer_path()
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), spc.PieceModel(open(path, "rb").read())
    rng = random.Random(9)
    texts = ODD + ["\0a\0\0b", "\0", "a" * 31, "a" * 32, "a" * 33] + ["".join(rng.choice("aeinrst ▁é日😀\0") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for t, got in zip(texts, model.encode_all(texts), strict=True):
        assert got[0].tolist() == sp.encode(t or "") and got[3] == sp.decode(got[0].tolist())
        for seg in model.cut.findall(model.normalize(t or "")[0]):
            assert (model.cache.get(seg) or model.old.get(seg) or model.segment(seg)) == model.segment(seg)


def test_charsmap_takes_longest_prefix():
    import sentencepiece

    try:
        norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
        blob = dict(spc._fields(dict(spc._fields(norm.serialized_model_proto()))[3]))[2]
    except (AttributeError, TypeError, KeyError, RuntimeError):
        pytest.skip("no normaliser in this version")
    model = spc.load_model(queries.tokenizer_path())
    other = spc.PieceModel.__new__(spc.PieceModel)
    other.__dict__.update(model.__dict__)
    other.charsmap, other.trim, other.dummy_prefix = spc.CharsMap(blob), True, True
    for t in ["ﬁne ｱｲ", "  two  spaces ", "①②", "Å Å", "㍿ x", "a\tb"]:
        text, align = other.normalize(t)
        assert text == norm.normalize(t), t
        assert len(align) == len(text.encode()) + 1 and (np.diff(align) >= 0).all()


def test_word_pieces_match_greedy(spark):
    vocab = ["▁a", "▁ab", "abc", "b", "bcd", "cdef", "▁", "de", "▁abcdx", "fg", "xyz"]
    pieces, longest = set(vocab), max(map(len, vocab))

    def greedy(w):
        n = i = 0
        while i < len(w):
            i = next((j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in pieces), i + 1)
            n += 1
        return n

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdefgxyz q") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in wordpiece_counts.count_tokens(frame(spark, texts), vocab).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        assert got[i] == (len(words), sum(greedy("▁" + w) for w in words))


def brute_hits(docs, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: rx.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for d in docs:
        w, hit, found = cut(d), set(), set()
        for k, t in items:
            x = cut(t)
            for n in range(max(1, len(x) - 7)) if x else ():
                p = x[n : n + 8]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        found.add(k)
        yield len(w), len(hit), sorted(found)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd Éf gh1 ij_k".split())
    items = [("10", " ".join(word() for _ in range(12))), ("9", "ab cd"), ("1", "gh1"), ("2", None), ("3", "!!"), ("4", "AB-cd éf gh1 ij k ab cd ab")]
    texts = ODD + [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(150)] + [items[0][1] + " tail", "x " * 50 + items[5][1]]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = dict(enumerate(brute_hits(texts, items)))
    for block in (1 << 20, 30):
        got = wu_manber.contamination_verdict(wu_manber.find_contamination(frame(spark, texts), bench, block_bytes=block)).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_words"], r["n_hit"], r["item_keys"]) == want[r["doc_id"]]
    empty = wu_manber.find_contamination(frame(spark, texts), bench.limit(0)).collect()
    assert all(not r["items"] for r in empty)


def test_leaks_are_passages_of_any_item(spark):
    item = [f"w{i}" for i in range(59)]
    texts = [" ".join(["lead"] + item[a : a + n] + ["tail"]) for a, n in ((0, 32), (20, 13), (20, 12), (0, 59))]
    texts += ["gh1 is here", " ".join(item[:10] + ["gap"] + item[30:40]), "s0 s1 s2 s3 s4 s5 s6 s7 s8", "s0 s1 s2 s3 s4 s5 s6 s7", " ".join(item[:8]) + " s0 s1 s2 s3 s4 s5 s6 s7", "gh1 ab cd", " ".join(item[:8]) + " gh1"]
    texts += ["r r r r r r r r r r r r r r", "r r r r r r r r r r r r"]
    items = [("long", " ".join(item)), ("one", "gh1"), ("two", "ab cd"), ("nine", "s0 s1 s2 s3 s4 s5 s6 s7 s8"), ("same", "r " * 20)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 20, 30):
        got = {r["doc_id"]: r for r in wu_manber.contamination_verdict(wu_manber.find_contamination(frame(spark, texts), bench, block_bytes=block)).collect()}
        assert [got[i]["leaked"] for i in range(len(texts))] == [True, True, False, True, False, False, True, False, True, False, False, True, False]


def plain_sets(texts, k):
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", w)
        yield {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, num, den):
    sets = list(plain_sets(texts, k))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def near_copies(rng, n):
    words = lambda k: [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(k)]
    out, base = [], [words(60) for _ in range(4)]
    passage = words(40)
    for _ in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else words(rng.randint(1, 80)) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(1)[0]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num,block", [(4, 85, 2000), (5, 80, 7)])
def test_jaccard_matches_brute_force(spark, k, num, block):
    texts = ODD + near_copies(random.Random(num), 120)
    want, sizes = brute_components(texts, k, num, 100)
    got = {r["doc_id"]: r for r in jj.jaccard_components(frame(spark, texts), k=k, num=num, block=block).collect()}
    assert [got[i]["component"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert got[None]["component"] is None


def test_divide_skip_finds_all(rng=random.Random(2)):
    sets = [np.unique(np.array([rng.randint(0, 60) for _ in range(rng.randint(1, 50))], np.uint64)) for _ in range(120)]
    index = jj.OccurrenceIndex(sets)
    for s in sets:
        for num in (50, 80, 100):
            want = [j for j, o in enumerate(sets) if 100 * len(set(s.tolist()) & set(o.tolist())) >= num * len(set(s.tolist()) | set(o.tolist()))]
            assert index.search(s, num, 100).tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (None, 3), (200, 200)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[101] == 100 and got[200] == 200


def test_rule_counts_match_brute_force(spark):
    rng = random.Random(8)
    texts = ODD + [" ".join(rng.choice(["aa", "b#", "C", "d|"]) for _ in range(rng.randint(0, 50))) for _ in range(60)]
    texts += ["l1 x\nl1 x\n \n\nl2\nl1 x", " ".join(map(str, range(30))) + " " + " ".join(map(str, range(30))), "w " * 8, "w " * 9]
    got = {r["doc_id"]: r for r in risk_rules.measure_rules(frame(spark, texts), keep=("row",)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        spots = {}
        for s in range(len(w) - 7):
            spots.setdefault(tuple(w[s : s + 8]), []).append(s)
        rep = {p + j for v in spots.values() if len(v) > 1 for p in v for j in range(8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)), t


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 50), (3, 400), (12, 2000), (0, 1), (90, 10000)]
    rows = spark.createDataFrame(cases, "k long, n long")
    for r in rows.withColumn("p", risk_rules.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect():
        p = Fraction(1, 100)
        want = float(sum(comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"] + 1))) if r["n"] <= 2000 else None
        if want is not None:
            assert want * (1 - 1e-9) <= r["p"] <= want * (1 + 1e-6) + 1e-12 or r["k"] >= r["n"] * 0.01 or r["p"] >= want


def test_risk_rules_limit_false_rejection(spark):
    good = " ".join(f"w{i}" for i in range(40))
    bad = " ".join(f"w{i}###" for i in range(40))
    rows = [(i, (good if i % 5 else bad) + f" {i}", "en") for i in range(4000)] + [(5000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 if i % 5 else 0) for i in range(4000)] + [(1, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in risk_rules.apply_rules(docs, labels).collect()}
    assert all(out[i] for i in range(4000) if i % 5) and not any(out[i] for i in range(0, 4000, 5)) and out[5000]
    none = risk_rules.apply_rules(docs, labels.limit(0))
    assert none.where("not kept").count() == 0


def test_rule_ensemble_learns_and_compiles(spark):
    rng = np.random.default_rng(0)
    x = rng.random((800, len(rule_ensemble.STATS)))
    y = ((x[:, 4] < 0.6) & (x[:, 2] < 0.8)).astype(float)
    model = rule_ensemble.fit_ensemble(x[:500], y[:500])
    assert (((model.logit(x[500:]) > 0) == y[500:]).mean()) > 0.95 and 0 < len(model.rules) < 300
    rows = spark.createDataFrame(x[500:].tolist(), [f"s_{s}" for s in rule_ensemble.STATS])
    got = np.array([r[0] for r in rows.select(model.score()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-model.logit(x[500:]))))
    docs, labels = frame(spark, ODD), spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    out = rule_ensemble.score_quality(docs, labels, F.lit(True), keep=("key", "row"))
    assert out.count() == len(ODD) + 1 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert rule_ensemble.score_quality(docs, labels.limit(0), F.lit(True)).where("score = 0.5").count() == len(ODD) + 1


def test_language_id(spark):
    en, de = "the cat sat on the mat with another cat and this dog ", "der hund und die katze sitzen auf einer matte "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 3 + str(i), "en" if i % 2 else "de") for i in range(40)] + [(99, None, "en"), (98, "123 !!", None)], "doc_id long, text string, lang string")
    content = language_id.learn_dictionaries(docs)
    assert sorted(content) == ["de", "en"]
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs, content).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and not got[i]["rejected"] for i in range(40))
    assert got[99]["lang_pred"] == got[98]["lang_pred"] == "und" and got[98]["score"] == 0
    none = language_id.identify_languages(docs, language_id.learn_dictionaries(docs.limit(0)))
    assert none.where("lang_pred = 'und'").count() == 42


def test_dictionaries_of_copies_and_banners(spark):
    rows = [("de", "immer derselbe text")] * 4000 + [("de", f"verschieden {chr(97 + i)}wort") for i in range(20)]
    rows += [("fr", "banner " * 300 + "contenu " * 900 + chr(97 + i)) for i in range(20)]
    train = spark.createDataFrame(rows, "lang string, text string")
    got = language_id.learn_dictionaries(train, texts=20)
    assert got["de"].count(b"verschieden") >= 15 and got["de"].count(b"immer") <= 1
    assert got["fr"].count(b"contenu") > got["fr"].count(b"banner")


def small_lexicon(short_list=3, classes=2, open_classes=3):
    top = [(b"aa", 9), (b"bb", 7), (recurrent_lm.END, 6), (b"cc,", 2), (b"d1", 1), (b"e", 1)]
    every = dict(top) | {b"zz": 1, b"yx": 1}

    def sums(borders):
        out = {}
        for w, c in every.items():
            n, v = out.get(recurrent_lm.open_class(w, borders), (0, 0))
            out[recurrent_lm.open_class(w, borders)] = n + c, v + 1
        return out

    return recurrent_lm.build_lexicon(top, sum(every.values()), len(every), sums, short_list, classes, open_classes), every


def test_network_gradients_are_numeric_gradients():
    lex, _ = small_lexicon()
    net = recurrent_lm.GatedNetwork(lex, 4, kind=np.float64)
    rng = np.random.default_rng(5)
    net.p = {n: rng.standard_normal(v.shape) * 0.5 for n, v in net.p.items()}
    words = [b"aa", b"bb", b"zz", recurrent_lm.END, b"bb", b"cc,", b"aa", b"d1", b"e", recurrent_lm.END]
    num = lex.numbers(words)
    cls = lex.classes(num)
    inp = lex.inputs(num, cls)
    lay = lambda a: np.asarray(a).reshape(2, 5).T
    args = lay(np.append(0, inp[:-1])), lay([True, False, False, False, True, False, False, False, True, False]), lay(cls), lay(num), lay([True] * 9 + [False]), rng.standard_normal((2, 4))
    _, g, used, _ = net.gradients(*args)
    full = np.zeros_like(net.p["x"])
    full[used] = g["x"]
    g["x"] = full
    for name, value in net.p.items():
        for at in np.ndindex(value.shape):
            old, sides = value[at], []
            for d in (1e-5, -1e-5):
                value[at] = old + d
                sides.append(net.gradients(*args)[0])
            value[at] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - g[name][at]) < 1e-6, (name, at)


def test_network_is_a_distribution_and_carries_its_state():
    lex, every = small_lexicon()
    net = recurrent_lm.GatedNetwork(lex, 4)
    state = np.random.default_rng(1).standard_normal((1, 4)).astype(np.float32)
    total, known = 0.0, set(every)
    below = lex.open_total + lex.open_distinct + 1

    def probability(w, count):
        num = lex.numbers([w])
        cls = lex.classes(num)
        p = float(np.exp(net.log_probs(state, cls, num)[0]))
        return p if 0 <= num[0] < lex.listed else p * (count + 1) / below[cls[0] - lex.short_classes]

    total = sum(probability(w, c) for w, c in every.items())
    unseen = {}
    for w in (b"qa", b"qb", b"q,", b"q1", b"qe", b"qz", b"q\xff", b"q\n", b"qd", b"qc"):
        unseen.setdefault(lex.open_class(w), probability(w, 0))
    assert set(range(len(lex.borders) + 1)) == set(unseen) and known
    assert abs(total + sum(unseen.values()) - 1) < 1e-4
    rng = random.Random(3)
    texts = [[rng.choice(list(every)) for _ in range(rng.randint(0, 90))] + [recurrent_lm.END] for _ in range(12)]
    flat = recurrent_lm.flatten(lex, texts)
    whole = recurrent_lm.score_texts(net, lex, flat)
    assert np.allclose(whole, recurrent_lm.score_texts(net, lex, flat, block=7), atol=1e-3)
    # one token after the other, as the recurrence says
    z, n = net.tables()
    for t, want in zip(texts, whole, strict=True):
        h, out = np.zeros((1, 4), np.float32), 0.0
        num = lex.numbers(t)
        cls = lex.classes(num)
        for a, c, x in zip(num, cls, lex.inputs(num, cls), strict=True):
            out += float(net.log_probs(h, np.array([c]), np.array([a]))[0]) / np.log(10)
            h = z[x] * h + (1 - z[x]) * n[x]
        assert abs(out - want) < 1e-3
    before = whole.sum()
    for _ in range(30):
        recurrent_lm.train_on(net, lex, texts, 0.02, streams=3, window=8)
    assert recurrent_lm.score_texts(net, lex, flat).sum() > before + 5


def test_open_classes_are_balanced():
    rng = random.Random(8)
    words = [(f"w{i}{rng.choice('abcdefgh')}{rng.choice('xyz.')}".encode(), rng.randint(1, 9)) for i in range(5000)]
    borders = recurrent_lm.open_borders(words, 16)
    mass = [0] * 16
    for w, c in words:
        mass[recurrent_lm.open_class(w, borders)] += c
    assert max(mass) < 1.1 * sum(mass) / 16 and len(borders) == 15
    assert recurrent_lm.open_borders([], 16) == [] and recurrent_lm.open_class(b"new", []) == 0


def test_network_trains_on_all_texts(spark):
    rows = spark.createDataFrame([(i, "the same text" if i < 300 else f"text {i}") for i in range(900)] + [(None, "null key")], "key long, text string")
    parts = [recurrent_lm.part_of_round(rows, k).collect() for k in range(recurrent_lm.ROUNDS)]
    assert sorted(str(r) for p in parts for r in p) == sorted(str(r) for r in rows.collect())
    # copies are dealt one by one, not all to one round
    copies = [sum(r["text"] == "the same text" for r in p) for p in parts]
    assert min(copies) > 90


def test_parameters_are_summed_by_part(spark):
    rng = np.random.default_rng(2)
    data = [(p, g, float(1 + g), rng.standard_normal(5).astype(np.float32)) for p in range(3) for g in (0, 1, 1, 2)]
    rows = spark.createDataFrame([(p, g, n, v.tobytes()) for p, g, n, v in data], "part int, grp int, n double, sums binary")
    out = recurrent_lm._sum_parts(recurrent_lm._sum_parts(rows, "part", "grp"), "part").collect()
    assert sorted(r["part"] for r in out) == [0, 1, 2]
    for r in out:
        assert r["n"] == 8.0 and np.allclose(np.frombuffer(r["sums"], np.float32), sum(v for p, _, _, v in data if p == r["part"]), atol=1e-5)


def test_network_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op3_lm_scores(spark, "/root/testdata/sf0.01").where("held_out")
    got = out.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens"), F.count("*")).first()
    assert got[0] > got[1] + 0.1 and got[2] == docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).count()


def test_lm_scores(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the cat sat", "der hund lief", "on a mat"]) for _ in range(rng.randint(3, 30))) for _ in range(80)] + [None, "", "Unseen wörd"]
    docs = frame(spark, texts)
    held = F.crc32(F.col("key").cast("string").cast("binary")) % 7 == 2
    got = {r["doc_id"]: r for r in recurrent_lm.score_documents(docs, ~F.coalesce(held, F.lit(False))).collect()}
    tok = lambda t: (t or "").lower().split() + ["\n"]
    counts = {}
    for i, t in enumerate([*texts, "null key"]):
        if zlib.crc32(str(i).encode() if i < len(texts) else b"") % 7 != 2:
            for w in tok(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        r = got[i]
        if r["train_tokens"] == n:
            want = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tok(t))
            assert abs(r["base_score"] - want) < 1e-6 and r["n_known"] == sum(w in counts for w in tok(t))
        assert r["n_tokens"] == len(tok(t)) and r["score"] < 0
    assert recurrent_lm.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "some words here\nmore words"), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0.\n"),
        (4, "z.txt", None), (5, "a/x.txt", "words words\nAll rights reserved.\n" + "plain text " * 20), (6, "ab/x.txt", "the license of the poet is under debate"), (7, None, ""), (8, "a/b/d/e.txt", "x"),
    ]
    files = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, path string, text string, key string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(files).collect()}
    assert [got[i]["license"] for i in range(1, 9)] == ["MIT", "Apache-2.0", "Apache-2.0", None, "Proprietary", None, None, "Apache-2.0"]
    assert got[2]["origin"] == "inherited" and got[2]["inherited_from"] == "a/b" and got[5]["origin"] == "own"
    assert license_scan.scan_licenses(files.limit(0)).count() == 0


def test_licence_lines_match_plain_cosine(spark):
    rng = random.Random(11)
    names = [t for _, t in license_scan.TEMPLATES]
    texts = []
    for _ in range(200):
        words = rng.choice(names).split() if rng.random() < 0.7 else []
        words = [w for w in words if rng.random() < 0.8] + [rng.choice(["mit", "words", "the", "License", "x1"]) for _ in range(rng.randint(0, 6))]
        texts.append("\n".join([" ".join(words), "plain text", rng.choice(names) if rng.random() < 0.1 else ""]))
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(files).collect()}
    split = license_scan._split
    found = [set(split(t)) for t in texts]
    idf = lambda w: np.log((len(texts) + 1) / (sum(w in f for f in found) + 1)) + 1 if w in known else np.log(len(texts) + 1) + 1
    known = {w for t in names for w in split(t)}
    weigh = lambda t: {w: split(t).count(w) * idf(w) for w in set(split(t))}
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    shapes = [(n, weigh(t)) for n, t in license_scan.TEMPLATES]
    for i, t in enumerate(texts):
        all_ = [(-round(sum(x * y.get(w, 0) for w, x in v.items()) / size(v) / size(y), 9), n) for v in map(weigh, t.split("\n")) if v for n, y in shapes]
        cos, name = min(all_)
        assert (got[i]["own_license"] == name and abs(got[i]["cosine"] + cos) < 1e-8) if -cos >= license_scan.LINE_COSINE else got[i]["own_license"] is None


def test_whole_licences_and_wrapped_headers(spark):
    full = {n: t for n, t in license_scan.full_templates()}
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License"
    code = "\nimport x\n" + "\n".join(f"value_{i} = call_{i}(arg)" for i in range(60))
    comment = lambda t: "\n".join("# " + x for x in t.split("\n"))
    notice = license_scan.NOTICES[0][1].split()
    notice = "\n".join(" ".join(notice[i : i + 5]) for i in range(0, len(notice), 5))
    rows = [
        (1, "m/LICENSE", "Copyright (c) 2020 Foo Bar\n\n" + full["MIT"]), (2, "m/src/a.py", "import y"), (3, "b/x.c", "int a;\n" + bsd + code), (4, "g/x.py", gpl + code),
        (5, "p/LICENSE", full["Apache-2.0"]), (6, "q/COPYING", full["GPL-3.0"]), (7, "r/LICENSE", full["BSD-3-Clause"]), (8, "s/x.py", comment(notice) + code), (9, "t/y.txt", "Released under the MIT License.\nfour words of prose"), (10, "t/z.txt", "more words"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(files).collect()}
    assert [got[i]["license"] for i in range(1, 11)] == ["MIT", "MIT", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "Apache-2.0", "MIT", None]
    assert [i for i in range(1, 11) if got[i]["is_license_file"]] == [1, 5, 6, 7]
    assert got[2]["inherited_from"] == "m" and got[3]["license_words"] >= len(license_scan._split(bsd))


def test_licence_weights_are_of_all_words(spark):
    rng = random.Random(12)
    names = [t for _, t in license_scan.TEMPLATES]
    line = "Licensed under the Apache License, Version 2.0. foo"
    texts = [line, "Released under the MIT License. See LICENSE"] + ["foo see " + " ".join(rng.choice(["alpha", "beta", "foo", "see"]) for _ in range(5)) for _ in range(300)]
    texts += [" ".join([w for w in rng.choice(names).split() if rng.random() < 0.9] + [rng.choice(["foo", "beta", "rare"]) for _ in range(rng.randint(0, 4))]) for _ in range(80)]
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(files, templates=license_scan.TEMPLATES, all_words=True).collect()}
    split = license_scan._split
    found = [set(split(t)) for t in texts]
    idf = lambda w: np.log((len(texts) + 1) / (sum(w in f for f in found) + 1)) + 1
    weigh = lambda t: {w: split(t).count(w) * idf(w) for w in set(split(t))}
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    shapes = [(n, weigh(t)) for n, t in license_scan.TEMPLATES]
    for i, t in enumerate(texts):
        v = weigh(t)
        cos, name = min((-round(sum(x * y.get(w, 0) for w, x in v.items()) / size(v) / size(y), 9), n) for n, y in shapes)
        assert (got[i]["own_license"] == name and abs(got[i]["cosine"] + cos) < 1e-8) if -cos >= license_scan.LINE_COSINE else got[i]["own_license"] is None
    assert got[0]["own_license"] == "Apache-2.0"
    pinned = {r["doc_id"]: r for r in license_scan.scan_licenses(files).collect()}
    assert got[0]["cosine"] > pinned[0]["cosine"]


def test_licences_of_deep_directories(spark):
    up = "/".join(f"d{i}" for i in range(69))
    rows = [(1, f"{up}/x/LICENSE", "Released under the MIT License."), (2, f"{up}/x/y/a.txt", "words"), (3, f"{up}/z/a.txt", "words"), (4, f"{up}/b.txt", "words"), (5, "/", "words"), (6, "//d0//b.txt", "words")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(files).collect()}
    assert [got[i]["license"] for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None] and got[2]["inherited_from"] == f"{up}/x"


def brute_repair(roles):
    """Cheapest legal sequence by trying all actions per turn."""
    best = {chat.START: 0}
    spread = lambda b: {t: min(b[s] + chat.INSERT_COST[s][t] for s in b if chat.INSERT_COST[s][t] < chat.FAR) for t in range(4) if any(chat.INSERT_COST[s][t] < chat.FAR for s in b)}
    for r in roles:
        own, new = chat.ROLES.get((r or "").strip().lower()), {}
        for s, c in best.items():
            if s != chat.START:
                new[s] = min(new.get(s, chat.FAR), c + chat.MERGE + (0 if s == own else chat.RELABEL))
        for s, c in spread(best).items():
            for t in chat.NEXT[s]:
                new[t] = min(new.get(t, chat.FAR), c + (0 if t == own else chat.RELABEL))
        best = new
    return min(spread(best)[e] for e in chat.ENDS)


def test_chat_repair(spark):
    rng = random.Random(6)
    convs = {i: [rng.choice(["user", "assistant", "system", "USER ", "tool", None]) for _ in range(rng.randint(1, 7))] for i in range(60)}
    convs[99] = [rng.choice(["user", "assistant"]) for _ in range(700)]
    rows = [(c, t, r, None if t % 5 == 4 else f"t{c}.{t}", 0) for c, rs in convs.items() for t, r in enumerate(rs)] + [(None, 0, "user", "x", 0), (5, 0, convs[5][0], "t5.0", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {}
    for r in chat.repair_conversations(turns).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for c, rs in convs.items():
        out = sorted(got[c], key=lambda r: r["position"])
        assert [r["position"] for r in out] == list(range(len(out)))
        assert sum(r["cost"] for r in out) == brute_repair([r["role"] for r in out])
        state, text = chat.START, "".join(r["rendered"] for r in out)
        for name in re.findall(r"<\|(system|user|assistant)\|>", text):
            assert chat.ROLES[name] in chat.NEXT[state]
            state = chat.ROLES[name]
        assert state in chat.ENDS and text.endswith("<|end|>\n")
        assert all((r["new_role"] in ("system", "user", "assistant")) for r in out)
    assert chat.repair_conversations(turns.limit(0)).count() == 0


def test_queries_hash_as_the_contract_says(spark):
    sf = "/root/testdata/sf0.001"
    r = queries.op1_decontamination(spark, sf).where("n_items = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest()
    docs = {x["doc_id"]: x for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_language_id(spark, sf).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and docs[r["doc_id"]]
