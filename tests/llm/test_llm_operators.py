"""Operators against brute force, with nulls, empty texts, repeated rows, long texts and clashing columns."""

import collections
import datetime
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnow.llm import gru, jaccard_join, line_dedup, lm_scoring, mixing, packing, pii, quality_rules, substring_dedup, tables, topk_search, toxicity
from winnow.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, kept_text string, n_words int"


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta Epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    passage = [word() for _ in range(60)]
    line = "A line that many documents share, word for word"
    rows = []
    for k in range(60):
        w = [word() for _ in range(rng.randrange(5, 150))]
        if k % 4 == 0:
            w[3:3] = passage
        text = " ".join(w)
        if k % 3 == 0:
            text += f"\n  {line.upper()}\t\n" + " ".join(w[:4])
        rows.append((k, text, f"s{k % 3}"))
    base = rows[7][1].split()
    rows += [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "s9") for k in range(2)]
    rows += [(110, rows[0][1], "s0"), (111, None, None), (112, "", "s1"), (113, " \n\t", "s1"), (114, "İ ſ x y", None)]
    rows += [(115, "que " * 90, "s2"), (116, " ".join(word() for _ in range(6000)), "s2"), (5, rows[5][1], rows[5][2])]
    return [(a, b, c, "clash", 1) for a, b, c in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def counted(rows):
    return collections.Counter(rows)


def test_line_dedup(docs):
    keys = collections.defaultdict(set)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i, t, *_ in ROWS:
        for x in (t or "").split("\n"):
            keys[norm(x)].add(i)
    want = []
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(norm(x)) >= 20 and len(keys[norm(x)]) >= 3 and max(keys[norm(x)]) != i)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.line_dedup(docs).collect()
    assert counted(want) == counted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got)


def test_quality_rules(docs):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t, *_ in ROWS:
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum((t or "").count(x) for x in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    noise = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(9000))
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    bands = quality_rules.Bands()
    assert not bands.verdict(noise.encode(), c)[2] and not bands.verdict(b"spam and eggs " * 500, c)[2]


def test_bands_reject_noise_and_keep_prose(spark):
    import zstandard

    c, bands, rng = zstandard.ZstdCompressor(level=3), quality_rules.Bands(), random.Random(8)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    tokens = lambda n, m: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=m)) for _ in range(n // (m + 1)))
    kept = lambda t: bands.verdict(t.encode(), c)[2]
    assert not any(kept(noise(n)) for n in (300, 600, 1500, 4000, 6000, 40000) for _ in range(10))
    assert not any(kept(tokens(n, m)) for n in (2000, 4000, 6000, 20000) for m in (6, 10, 16) for _ in range(10))
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if len((r["text"] or "").split()) >= 50]
    before = quality_rules.Bands(below=(256, 1024, 4096, 16384), low=(0.0,) * 5, high=(3.0, 2.9, 3.3, 3.6, 4.0), chunk_low=0.0)
    assert all(kept(t) == before.verdict(t.encode(), c)[2] for t in docs)
    prose = [t for t in docs if kept(t) and len(t) > 1000]
    assert not any(kept(t[:1000] + noise(3000)) or kept(t[:3000] + noise(9000)) for t in prose[:50])
    long = next(t for t in docs if kept(t) and len(t.encode()) > 24000)
    assert kept(long[:20000]) and not kept(long[:20000] + noise(20000)) and bands.verdict((long[:5000] + noise(3000)).encode(), c)[1] == 1 - 4096 / len((long[:5000] + noise(3000)).encode())


def test_packing(docs):
    path = packing.default_tokenizer()
    got = packing.pack(docs, path, window=64, shard_rows=16).collect()
    tok = packing.WordTokenizer(path).tokenizer
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in ROWS}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        import numpy as np

        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for i, rows in by_doc.items():
        times = sum(1 for x in ROWS if x[0] == i)
        assert counted(k for r in rows for k in range(r["start"], r["start"] + r["length"])) == {k: times for k in range(len(ids[i]))}
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or at & (at - 1) == 0


def test_sum_of_squares_rule():
    rng = random.Random(2)
    state = packing.SumOfSquares(32)
    for item in range(300):
        length = rng.randrange(1, 32)
        counts = state.counts.copy()
        best = min(
            sum(int(x) ** 2 for h, x in enumerate(moved) if 0 < h < 32)
            for level in range(33 - length) if level == 0 or counts[level]
            for moved in [[int(x) - (h == level and h > 0) + (h == level + length) for h, x in enumerate(counts)]]
        )
        state.place(item, length)
        assert sum(int(x) ** 2 for x in state.counts[1:32]) == best


def brute_classes(rows, n, percent):
    sets = []
    for i, t, *_ in rows:
        w = words((t or "").translate(FOLD))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return counted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("limits", [{}, {"task_documents": 2, "task_points": 2, "task_shingles": 50}])
def test_jaccard_classes(docs, limits):
    got = jaccard_join.jaccard_classes(docs, **limits).collect()
    assert brute_classes(ROWS, 4, 85) == counted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


def test_substring_dedup(docs):
    c = collections.Counter(tuple(w[k : k + 35]) for _, t, *_ in ROWS for w in [words(t)] for k in range(len(w) - 34))
    want = []
    for i, t, *_ in ROWS:
        w = words(t)
        gone = {k + d for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for d in range(35)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.remove_repeats(docs, shard_rows=8).collect()
    assert counted(want) == counted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got)


def test_mixing(docs):
    got = mixing.mix(docs, shard_rows=8).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(x[0] for x in ROWS)
    total, taken = collections.Counter(), collections.Counter()
    for r in got:
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    target = {r["source"]: r["target"] for r in got}
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6 * sum(total.values())
    for s, t in target.items():
        assert t <= 2 * total[s] + 1e-9 and abs(taken[s] - t) <= 0.02 * t + 3
    again = mixing.mix(docs.repartition(5), shard_rows=8).collect()
    assert counted((r["doc_id"], r["taken"]) for r in got) == counted((r["doc_id"], r["taken"]) for r in again)
    texts = mixing.taken_texts(mixing.mix(docs, shard_rows=8, carry=("text",))).collect()
    per = collections.Counter()
    for r in texts:
        per[r["doc_id"]] += len(words(r["text"]))
    want = collections.Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert +per == +want


def test_sainte_lague():
    rng = random.Random(4)
    for _ in range(50):
        votes = [float(rng.randrange(1, 500)) for _ in range(rng.randrange(1, 7))]
        seats = rng.randrange(0, 60)
        held = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda j: (votes[j] / (2 * held[j] + 1), -j))
            held[k] += 1
        assert mixing.sainte_lague(votes, seats, [10**6] * len(votes)) == held


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hits = [r for r in rows if r["predicted"] == 1]
    assert sum(r["toxic"] for r in hits) >= 0.95 * len(hits)
    assert sum(r["toxic"] for r in hits) >= 0.75 * sum(r["toxic"] for r in rows)
    assert all(r["held_out"] == toxicity.is_held_out(r["doc_id"]) for r in rows)


def test_counterfactual_penalty():
    import numpy as np

    f = lambda t: np.array(sorted({x for w in t.split() for x in toxicity.word_features(w)}))
    swaps = toxicity.swap_table(toxicity.IDENTITY_TERMS)
    texts = [(f"the muslim is an idiot {k % 7}", 1) for k in range(30)] + [(f"a calm day for walks {k % 7}", 0) for k in range(60)]
    rows = [(f(t), f(" ".join(swaps.get(w, w) for w in t.split())), y) for t, y in texts]
    neutral = W.split(__import__("pyarrow").array(["the muslim is here", "an idiot"]))
    free, bound = toxicity.fit(rows, counterfactual=0.0).scores(neutral), toxicity.fit(rows, counterfactual=20.0).scores(neutral)
    assert bound[0] < free[0] and bound[1] > 0.5


def test_counterfactual_penalty_works_on_texts_without_terms(spark):
    """No labelled text of these tables mentions a group; the fit still depends on the penalty, and mentions stay neutral."""
    import numpy as np

    sf = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").selectExpr("doc_id AS _id", "cast(toxic AS int) AS _label", "coalesce(text, '') AS text")
    free, bound = (toxicity.fitted(labelled, toxicity.IDENTITY_TERMS, c) for c in (0.0, 20.0))
    own = toxicity.term_features(toxicity.IDENTITY_TERMS)
    assert not np.allclose(free.weights, bound.weights)
    weight = lambda m, t: sum(m.weights[f] for f in set(toxicity.word_features(t)))
    apart = lambda m: np.mean([abs(weight(m, a) - weight(m, b)) for a, b in toxicity.swap_table(toxicity.IDENTITY_TERMS).items()])
    assert apart(bound) < 0.8 * apart(free) and len(own) > 100, (apart(bound), apart(free))
    again = toxicity.fitted(labelled.repartition(3), toxicity.IDENTITY_TERMS, 20.0)
    assert np.array_equal(again.weights, bound.weights) and again.bias == bound.bias
    neutral = W.split(pa.array(["the muslim women of the town met the christian men"]))
    assert bound.scores(neutral)[0] < 0.5


def test_toxicity_edge_rows(spark):
    rows = [(k, f"you idiot number {k}" if k % 2 else f"a calm day number {k}", 1.0, "x") for k in range(40)]
    rows += [(100, None, 0.0, "x"), (101, "", 0.0, "x"), (None, "you idiot", 0.0, "x"), (3, rows[3][1], 1.0, "x"), (102, "calm " * 50_000 + "idiot", 0.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(100, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[100]["score"] == by[101]["score"] and not by[None]["held_out"] and by[None]["predicted"] == 1
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1 and by[102]["predicted"] == 1 and by[8]["predicted"] == 0
    assert all(r["score"] == 0.5 for r in toxicity.score_toxicity(df, labels.filter("false")).collect())


def test_lm_scores(docs):
    import math

    got = lm_scoring.lm_scores(docs).collect()
    train = [x for x in ROWS if zlib.crc32(str(x[0]).encode()) % 5 != 1]
    c = collections.Counter(w for x in train for w in [*words((x[1] or "").translate(FOLD)), " "])
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t, *_ in ROWS:
        w = [*words((t or "").translate(FOLD)), " "]
        want[i] = (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    for r in got:
        k, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (k, known, n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0


def test_lm_learns_from_all_documents_in_rounds(spark, monkeypatch):
    rng = random.Random(6)
    pairs = ["a x1", "b x2", "c x3", "d x4", "e x5"]
    texts = [" ".join(rng.choice(pairs) for _ in range(30)) for _ in range(240)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables, total = [], {}
    write = lm_scoring.materialize
    monkeypatch.setattr(lm_scoring, "materialize", lambda d: tables.append(write(d)) or tables[-1])
    monkeypatch.setattr(lm_scoring, "discard", lambda *t: None)
    for parallel, fan_in in ((1000, 32), (2, 2)):
        monkeypatch.setattr(lm_scoring, "PARALLEL", parallel)
        monkeypatch.setattr(lm_scoring, "FAN_IN", fan_in)
        total[parallel] = sum(r["score"] for r in lm_scoring.lm_scores(df, learner_tokens=800).filter("held_out").collect())
    again = sum(r["score"] for r in lm_scoring.lm_scores(df.repartition(7), learner_tokens=800).filter("held_out").collect())
    assert total[2] > total[1000] and abs(again - total[2]) < 1e-6 * abs(again)
    dealt = [t for t in tables if t.columns == ["_row", "_learner", "ids"]]
    trained = sum(zlib.crc32(str(k).encode()) % 5 != 1 for k in range(240))
    assert [t.count() for t in dealt] == [trained] * 3 and dealt[0].select("_learner").distinct().count() > 4


def test_lm_scores_equal_a_plain_loop(docs, monkeypatch):
    """score against one step and one softmax at a time, over the same parameters and counts."""
    import math

    import numpy as np

    kept = []
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda t, lexicon, **k: kept.append((lexicon, train(t, lexicon, **k))) or kept[-1][1])
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs, vocabulary=64).filter("doc_id < 200").collect()}
    lexicon, flat = kept[0]
    assert len(lexicon.ids) == 64
    model = gru.Gru(lexicon.model_counts).load(flat)
    train_rows = [x for x in ROWS if zlib.crc32(str(x[0]).encode()) % 5 != 1]
    c = collections.Counter(w for x in train_rows for w in [*words((x[1] or "").translate(FOLD)), " "])
    outside = {w: k for w, k in c.items() if w not in lexicon.ids}
    below = sum(outside.values()) + 0.5 * (len(outside) + 1)
    p = model.p
    for i, t, *_ in ROWS[:12] + ROWS[-9:-3]:
        h, total = np.zeros((1, model.hidden)), 0.0
        for w in [*words((t or "").translate(FOLD)), " "]:
            k = lexicon.ids.get(w, lexicon.unknown)
            cls = model.of[k]
            logits = (h @ p["class_w"] + p["class_b"])[0]
            inner = (h @ p["word_w"] + p["word_b"])[0][model.first[cls] : model.first[cls + 1]]
            total += logits[cls] - math.log(sum(math.exp(x) for x in logits)) + inner[k - model.first[cls]] - math.log(sum(math.exp(x) for x in inner))
            if w not in lexicon.ids:
                total += math.log((c[w] + 0.5) / below)
            x = p["embed"][k] @ p["wx"] + p["b"]
            h = model.step(x[None], h)
        assert abs(got[i] - total / math.log(10)) < 1e-3 * max(1, abs(total)), i


def test_gru_probabilities_sum_to_one_and_gradients():
    import numpy as np

    model = gru.Gru(np.array([50, 30, 9, 7, 5, 3, 2, 1.0]), classes=3, embed=5, hidden=6)
    h = np.random.default_rng(0).normal(size=(1, 6)).astype(np.float32)
    logs = model.log_probs(np.repeat(h, 8, axis=0), np.arange(8))
    assert abs(np.exp(logs).sum() - 1) < 1e-5
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64) + np.random.default_rng(1).normal(0, 0.1, model.p[k].shape)
    tokens = np.random.default_rng(2).integers(0, 8, (5, 3))
    fresh, live = np.zeros((5, 3), bool), np.ones((5, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    g, _, _ = model.gradients(tokens, fresh, live, np.zeros((3, 6)))
    for k, at in (("u", (2, 7)), ("wx", (1, 3)), ("embed", (tokens[1, 0], 2)), ("word_w", (1, 4)), ("class_w", (0, 1)), ("b", (14,))):
        old = model.p[k][at]
        model.p[k][at] = old + 1e-4
        up = model.gradients(tokens, fresh, live, np.zeros((3, 6)))[2]
        model.p[k][at] = old - 1e-4
        down = model.gradients(tokens, fresh, live, np.zeros((3, 6)))[2]
        model.p[k][at] = old
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-2 * max(1, abs(g[k][at])), k


def test_gru_state_crosses_windows():
    import numpy as np

    model = gru.Gru(np.arange(20, 0, -1.0), classes=4)
    ids = np.random.default_rng(0).integers(0, 20, 300)
    starts = np.array([0, 200, 200, 300])
    one = model.score(ids, starts, window=1000)
    assert np.allclose(one, model.score(ids, starts, window=7, cells=1), rtol=1e-5) and one[1] == 0


def noise(key, tweak, i, x):
    return int(hashlib.sha256(f"{key}{tweak}{i}:{x}".encode()).hexdigest()[:15], 16)


def feistel(a, b, mod_a, mod_b, tweak, key):
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            a = (a + noise(key, tweak, i, b)) % mod_a
        else:
            b = (b + noise(key, tweak, i, a)) % mod_b
    return a, b


def permuted(d, tweak, key):
    high = len(d) - len(d) // 2
    a, b = feistel(int(d[:high]), int(d[high:]), 10**high, 10 ** (len(d) - high), tweak, key)
    return f"{a:0{high}d}{b:0{len(d) - high}d}"


def laid_out(text, digits, skip=0):
    out, n = "", 0
    for c in text:
        if c.isdigit():
            out += c if n < skip else digits[n - skip]
            n += 1
        else:
            out += c
    return out


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, d[::-1]))) % 10


def renamed(name, key):
    half = [name[: len(name) // 2], name[len(name) // 2 :]]
    for i in range(1, pii.ROUNDS + 1):
        own, other = half[(i + 1) % 2], half[i % 2]
        n = hashlib.sha512(f"{key}mail{i}:{len(own)}:{other}".encode()).hexdigest()
        moved = ""
        for k, c in enumerate(own):
            by = int(n[4 * (k % 32) : 4 * (k % 32) + 4], 16)
            base, many = (48, 10) if c.isdigit() else (97, 26) if "a" <= c <= "z" else (65, 26)
            moved += chr(base + (ord(c) - base + by) % many) if c.isalnum() else c
        half[(i + 1) % 2] = moved
    return "".join(half)


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_pii_against_plain_python(spark):
    rng, key = random.Random(8), "a'key\\"
    cards, dates, hosts, phones, mails, ibans = [], [], [], [], [], []
    for _ in range(40):
        d = "".join(rng.choice("0123456789") for _ in range(rng.choice([13, 15, 16, 19])))
        cards.append(d[:-1] + str(-luhn(d[:-1] + "0") % 10))
        dates.append(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(60_000)))
        hosts.append(".".join(str(rng.randrange(256)) for _ in range(4)))
        phones.append(f"+{rng.randrange(1, 1000)} ({rng.randrange(100, 1000)}) {rng.randrange(100, 1000)}-{rng.randrange(1000, 10_000)}")
        mails.append("".join(rng.choice("abzAZ09._+") for _ in range(rng.randrange(2, 40))) + "@mail.example.org")
        bban = rng.choice(["", "ABCD"]) + "".join(rng.choice("0123456789") for _ in range(rng.choice([8, 11, 16, 20])))
        country = rng.choice(["DE", "GB", "NO"])
        ibans.append(f"{country}{98 - mod97(country + '00' + bban):02d}{bban}")
    ibans[0] = ibans[0][:4] + " " + " ".join(ibans[0][k : k + 4] for k in range(4, len(ibans[0]), 4))
    want = {}
    for c in cards:
        p = permuted(c[:-1], "card", key)
        want[c] = p + str(-luhn(p + "0") % 10)
    start = datetime.date(1600, 1, 1).toordinal()
    for x in dates:
        n = x.toordinal() - start
        a, b = feistel(n % pii.CYCLE // pii.CYCLE_B, n % pii.CYCLE % pii.CYCLE_B, pii.CYCLE_A, pii.CYCLE_B, "date", key)
        want[x.isoformat()] = datetime.date.fromordinal(start + n - n % pii.CYCLE + a * pii.CYCLE_B + b).isoformat()
    for x in hosts:
        q = list(map(int, x.split(".")))
        a, b = feistel(q[0] * 256 + q[1], q[2] * 256 + q[3], 65536, 65536, "address", key)
        want[x] = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for x in phones:
        digits, country = re.sub(r"\D", "", x), len(re.match(r"\+(\d{1,3})", x)[1])
        want[x] = laid_out(x, permuted(digits[country:], "phone", key), country)
    for x in mails:
        want[x] = renamed(x.split("@")[0], key) + "@mail.example.org"
    for x in ibans:
        c = x.replace(" ", "")
        bban = laid_out(c[4:], permuted(re.sub(r"\D", "", c[4:]), "account", key))
        new = iter(f"{c[:2]}{98 - mod97(c[:2] + '00' + bban):02d}{bban}")
        want[x] = "".join(" " if ch == " " else next(new) for ch in x)
        assert mod97(want[x].replace(" ", "")) == 1
    values = list(want)
    df = spark.createDataFrame([(k, f"so: {v}; and") for k, v in enumerate(values)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, key).collect()}
    for k, v in enumerate(values):
        assert got[k] == f"so: {want[v]}; and", v
    assert len(set(want.values())) == len(values)


def test_pii_edge_rows(spark):
    long = "word " * 40_000 + "10.1.2.3 " + "é" * 1000
    rows = [(1, "a 10.1.2.3", "c", 7), (1, "a 10.1.2.3", "c", 7), (None, "10.1.2.3", "d", 8), (3, long, "e", 9), (4, "DE00 3704 0044 0532 0130 00 x", "f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_found string, d int")
    out = pii.pseudonymise(df, "k", carry=("d",))
    assert out.columns == ["doc_id", "n_found", "n_replaced", "text", "d"]
    got = out.collect()
    host = next(r["text"] for r in got if r["doc_id"] is None)
    assert [r["text"] for r in got if r["doc_id"] == 1] == [f"a {host}"] * 2 and host != "10.1.2.3"
    assert next(r["text"] for r in got if r["doc_id"] == 3) == long.replace("10.1.2.3", host)
    assert next(r["text"] for r in got if r["doc_id"] == 4) == rows[4][1]


@pytest.mark.parametrize("part", ["a", "1", "1.", "_2020-01-01", "a@", "+1.", "x@a.", "AB12 "])
def test_pii_unbroken(spark, part):
    """A million characters of one run take seconds, and values after it are found."""
    text = part * (1_000_000 // len(part))
    rows = [(1, f"a.b@c.example.com {text} 10.0.0.1 a.b@c.example.com"), (2, "10.0.0.1 a.b@c.example.com (555) 123-4567foo.bar@x.com")]
    began = time.time()
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "k").collect()}
    assert time.time() - began < 30
    host, name = got[2].split()[:2]
    assert got[1].startswith(f"{name} ") and got[1].endswith(f" {host} {name}") and name != "a.b@c.example.com"
    assert "foo.bar@" not in got[2] and got[2].endswith("@x.com")


def test_most_frequent_words(spark):
    rows = [(f"w{k}", 7) for k in range(3000)] + [(f"t{k}", 100 + k % 3) for k in range(90)] + [("top", 10**7)]
    counts = spark.createDataFrame(rows, "word string, c long").repartition(3)
    for limit in (0, 1, 50, 91, 1000, 2500, 3091, 9999):
        got = lm_scoring.most_frequent(counts, limit)
        assert len(got) == len(set(got)) == min(limit, len(rows)) and set(got) <= set(rows)
        assert sorted((c for _, c in got), reverse=True) == sorted((c for _, c in rows), reverse=True)[:limit]
        assert got == lm_scoring.most_frequent(counts.repartition(5), limit) or set(got) == set(lm_scoring.most_frequent(counts.repartition(5), limit))


def test_lm_words_of_equal_count(spark):
    """More words of one count than are kept at hand: the vocabulary is full, and the model beats the base."""
    rng = random.Random(1)
    words_ = [f"w{k}" for k in range(140_000)]
    rng.shuffle(words_)
    rows = [(k, " ".join(x for w in words_[k * 700 : (k + 1) * 700] for x in ("the", w))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = lm_scoring.lm_scores(docs).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > out.b


def test_pii(spark):
    texts = ["on 2024-02-29, 31.12.1999 or 30/02/2001; 4111 1111 1111 1111, 4111111111111112 x 1.2.3.256 10.0.0.1.", "again 2024-02-29 4111111111111111 10.0.0.1 +49 (030) 555-1234 a.b@c.example.com", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    assert out[2] is None and out[3] == ""
    a, b = out[0], out[1]
    assert "30/02/2001" in a and "4111111111111112" in a and "1.2.3.256" in a
    date, card, host = re.search(r"again (\S+) (\d{16}) (\S+)", b).groups()
    assert date in a and re.sub(r"\D", "", re.search(r"; ([\d ]{19}),", a)[1]) == card and host + "." in a
    assert (date, card, host) != ("2024-02-29", "4111111111111111", "10.0.0.1") and "a.b@" not in b and "555-1234" not in b
    digits = [int(x) for x in card[::-1]]
    assert sum(digits[0::2] + [x * 2 - 9 * (x > 4) for x in digits[1::2]]) % 10 == 0


def test_pii_layouts(spark):
    values = ["+49 30 1234567", "+1-555-123-4567", "(555) 123-4567", "555-123-4567", "+493012345678", "+44 20 7946 0958", "+33 1 23 45 67 89", "3782 822463 10005", "12/31/1999", "02/29/2024"]
    stays = ["3782 822463 10006", "02/30/2024", "+12 34", "13/31/1999"]
    df = spark.createDataFrame(list(enumerate(f"call {v}, or" for v in values + stays)), "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    shape = lambda t: re.sub(r"\d", "9", t)
    for v, t in zip(values, out):
        assert t != f"call {v}, or" and shape(t) == shape(f"call {v}, or"), v
    assert out[len(values) :] == [f"call {v}, or" for v in stays]
    digits = [int(x) for x in re.sub(r"\D", "", out[7])[::-1]]
    assert sum(digits[0::2] + [x * 2 - 9 * (x > 4) for x in digits[1::2]]) % 10 == 0 and out[0].startswith("call +49 ")


def test_pii_is_a_permutation(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = pii.pseudonymise(df, "k")
    assert out.select("text").distinct().count() == 3000 and out.filter("n_replaced < 0 OR n_found <> 1").count() == 0


@pytest.mark.parametrize("size", [60, 240, 990, 3900])
def test_jaccard_bound_parts_unrelated_sets_of_one_key(size):
    rng = np.random.default_rng(5)
    sets = [np.unique(np.append(rng.integers(0, 1 << 63, size, np.uint64), np.uint64(77))) for _ in range(60)]
    copies = [np.unique(np.append(s[: size * 19 // 20], rng.integers(0, 1 << 63, 1, np.uint64))) for s in sets[:2]]
    sizes = np.array([len(s) for s in sets + copies])
    left, right = jaccard_join.block_edges(np.zeros(62, np.int64), np.arange(62), [jaccard_join.packed_point(s) for s in sets + copies], sizes, 80)
    assert {tuple(sorted(e)) for e in zip(left, right, strict=True)} == {(0, 60), (1, 61)}


def test_jaccard_keys_of_the_same_documents_meet_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard_join, "materialize", lambda df: seen.append(tables.materialize(df)) or seen[-1])
    a = [f"a{k}" for k in range(2000)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[:-20])), (3, "alone in here now")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert [t.count() for t in seen if t.columns == ["_key", "_rep"]] == [2]


def test_jaccard_links_all_sets_of_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, "alone in here now")], "doc_id long, text string")
    got = counted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_classes(df).collect())
    assert got == counted([(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)])


def bm25(rows, q, k):
    """k best (score, doc_id) of the words of document q by a plain loop."""
    import math

    tf = [(i, collections.Counter(words((t or "").translate(FOLD)))) for i, t in rows]
    df = collections.Counter(w for _, c in tf for w in c)
    mean = sum(sum(c.values()) for _, c in tf) / len(tf)
    idf = {w: math.log(1 + (len(tf) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    own = {w for i, c in tf if i == q for w in c}
    score = lambda c: sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in own if c[w])
    return [(-s, i) for s, i in sorted((-round(score(c), 6), i) for i, c in tf if any(c[w] for w in own))[:k]]


def test_topk(docs):
    got = topk_search.search(docs, docs.filter("doc_id % 10 = 0 OR doc_id = 5"), k=5, shard_rows=10, block_terms=300).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append((round(r["score"], 6), r["doc_id"]))
    rows = [x[:2] for x in ROWS if x[0] is not None]
    for q in {i for i, _ in rows if i % 10 == 0 or i == 5}:
        assert by[q] == bm25(rows, q, 5), q
    assert {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_topk_repeats_ties_and_nulls(spark):
    rows = [(k, "same words here", None) for k in (4, 2, 9, 7)] + [(5, "other words", None)] * 2 + [(None, "same words here", None), (6, None, None), (8, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = topk_search.search(df, df.union(df), k=3, shard_rows=2).collect()
    by = {q: [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert by == {**{q: [2, 4, 7] for q in (2, 4, 7, 9)}, 5: [5, 5, 2]}
    best = {r["query_id"]: r["score"] for r in got if r["rank"] == 1}
    assert abs(best[4] - bm25([r[:2] for r in rows if r[0] is not None], 4, 1)[0][0]) < 1e-6


def test_topk_prunes():
    """Over real texts, many postings are never read and most documents never scored; what is scored is exact."""
    import numpy as np
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    order, lengths, w, term, doc, times = topk_search.lists_of(texts)
    n, first = len(lengths), np.searchsorted(term, np.arange(len(w.vocabulary) + 1))
    df = np.diff(first)
    shard = topk_search.Shard(np.arange(len(df)), first, doc, times, lengths, np.log(1 + (n - df + 0.5) / (df + 0.5)), lengths.mean())
    asked, postings = [np.unique(w.codes[a:b]) for a, b in zip(w.starts[:-1], w.starts[1:])][::20], 0
    for q in asked:
        d, s = shard.top(q, 10, 0.0)
        whole = np.zeros(n)
        for t in q:
            at = slice(first[t], first[t + 1])
            whole[doc[at]] += shard.impact[at]
            postings += df[t]
        want = np.sort(whole[whole > 0])[::-1][:10]
        assert np.array_equal(np.sort(s)[::-1][:10], want) and np.array_equal(whole[d], s)
    assert shard.scored < 0.35 * n * len(asked), (shard.walked / postings, shard.scored / n / len(asked))
    shard.walked = shard.scored = 0
    for q in asked:  # from the threshold that an earlier round gives
        best = np.sort(shard.top(q, 10, 0.0)[1])[::-1][:10]
        before = shard.walked, shard.scored
        d, s = shard.top(q, 10, float(best[-1]))
        assert np.array_equal(np.sort(s)[::-1][: len(best)], best) and shard.scored - before[1] <= before[1]


def test_topk_queries_go_together():
    """From a threshold on, queries that go together find what each finds by itself, and read a fraction of the postings."""
    import numpy as np
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    _, lengths, w, term, doc, times = topk_search.lists_of(texts)
    n, first = len(lengths), np.searchsorted(term, np.arange(len(w.vocabulary) + 1))
    df = np.diff(first)
    shard = topk_search.Shard(np.arange(len(df)), first, doc, times, lengths, np.log(1 + (n - df + 0.5) / (df + 0.5)), lengths.mean())
    asked = [np.unique(w.codes[a:b]) for a, b in zip(w.starts[:-1], w.starts[1:])][::7]
    codes, starts = np.concatenate(asked), np.cumsum([0, *map(len, asked)])
    for part in (1.0, 0.5):
        alone = [shard.top(q, 10, 0.0) for q in asked]
        bounds = np.array([part * np.sort(s)[::-1][:10][-1] if len(s) else 0.0 for _, s in alone])
        some = np.flatnonzero(bounds > 0)[1:]
        shard.walked = 0
        want = {q: shard.top(asked[q], 10, bounds[q]) for q in some.tolist()}
        before, shard.walked = shard.walked, 0
        best = lambda d, s: sorted(zip((-s).tolist(), d.tolist()))[:10]
        got = {q: best(d, s) for q, d, s in shard.top_together(codes, starts, some, 10, bounds)}
        assert {q: [x for x, _ in v] for q, v in got.items()} == {q: [x for x, _ in best(d, s)] for q, (d, s) in want.items()}
        assert shard.walked < 0.6 * before
        for q, hits in got.items():
            whole = np.zeros(n)
            for t in asked[q]:
                whole[doc[first[t] : first[t + 1]]] += shard.impact[first[t] : first[t + 1]]
            assert all(whole[d] == -s for s, d in hits)


def test_topk_few_shards_are_dealt(docs, monkeypatch):
    """A round of fewer shards than tasks is searched by several tasks, each for a part of the queries."""
    queries = docs.filter("doc_id % 10 = 0 OR doc_id = 5")
    rows = lambda: sorted(tuple(r) for r in topk_search.search(docs, queries, k=5, shard_rows=10).collect())
    want, seen, real = rows(), [], topk_search.materialize
    monkeypatch.setattr(topk_search, "PART", 2)
    monkeypatch.setattr(topk_search, "materialize", lambda df: seen.append(df.rdd.getNumPartitions()) or real(df) if df.columns == ["query_id", "_id", "score"] else real(df))
    assert rows() == want and seen[0] > 1


@pytest.mark.parametrize(
    "run",
    [
        line_dedup.line_dedup, quality_rules.quality_rules, lambda d: packing.pack(d, packing.default_tokenizer()), jaccard_join.jaccard_classes,
        substring_dedup.remove_repeats, mixing.mix, lm_scoring.lm_scores, lambda d: pii.pseudonymise(d, "k"), lambda d: topk_search.search(d, d),
        lambda d: toxicity.score_toxicity(d, d.selectExpr("doc_id", "n_words AS toxic")),
    ],
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    own = docs.selectExpr("doc_id", "text", "'en' AS lang", "source", "1L AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, own, "")
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            own = out.persist()
    kept = {r["doc_id"] for r in own.collect()}
    assert 112 not in kept and kept


def test_near_stage_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(9)
    a, b, c, d, e = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(5))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (None, c), (None, a), (4, d), (4, e)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_stage(spark, df, "").collect()
    assert counted((r["doc_id"], r["text"]) for r in got) == counted([(1, a), (3, b), (4, d), (4, e), (None, c), (None, a)])


def test_slices_are_lower_cased_right():
    import pyarrow as pa

    a = pa.array(["ÄB C", "De Fé", "Gh"] * 50)
    part = a.slice(100, 40)
    w = W.split(part, lower=True)
    assert [w.vocabulary[int(c)].as_py() for c in w.codes] == [x for t in part.to_pylist() for x in t.translate(FOLD).split()]
    assert hashlib.sha256(b"").hexdigest()


def test_word_tokenizer_equals_whole_texts():
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    assert tokenizer.units is not None
    rng = random.Random(3)
    alphabet = list("aAbZſK'̧́,.;-<|> \n\t19éßΣst") + ["'s", "'ll", "<|endoftext|>", "<|STARTOFTEXT|>", "\x85", "\x1f"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [None, "", "don't,stop's. re've! we'd? ''''s", "</w> w</w> a<b|c <| |>", "a" * 5000 + ", b"]
    ids, starts = tokenizer.encode(pa.array(texts))
    for k, text in enumerate(texts):
        whole = tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[starts[k] : starts[k + 1]].tolist() == whole
