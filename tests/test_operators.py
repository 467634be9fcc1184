import collections
import datetime as dt
import difflib
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions.rules import Lexicon
from winnow.operators import evaluate, increments, sequence, service, tables
from winnow.streaming import state

ROWS = [("a b", 0, "s1", "f", 1), ("a b", 1, "s2", "f", 2), ("a b", 1, "s2", "f", 3), ("c", 1, "s1", "f", 4), ("c", 1, "s0", "f", 5), ("d", 0, "s1", "f", 6)]
SCHEMA = "text string, label int, kaynak string, dosya string, satir_no long"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_conflicts_and_duplicates(df):
    assert [r["text"] for r in tables.conflict_texts(df).collect()] == ["a b"]
    assert sorted(r["satir_no"] for r in tables.quarantine(df).collect()) == [4, 5, 6]
    assert sorted(r["satir_no"] for r in tables.majority(df).collect()) == [2, 3, 4, 5, 6]
    assert tables.duplicate_rows(df).count() == 5
    assert sorted(r["satir_no"] for r in tables.first_rows(df).collect()) == [1, 5, 6]


def test_near_groups_and_entities(spark):
    rows = [
        ("sabah erken kalkıp parkta uzun uzun yürüdük", ""), ("erken sabah kalkıp parkta uzun uzun yürüdük", ""), ("kütüphanede sessizce ders çalışan öğrenciler", "u1"),
        ("akşam yemeğine mercimek çorbası pişirdiler", "u1"), ("tren garına geç kalmamak gerekiyor", ""), ("sabah erken kalkıp parkta uzun uzun yürüdük", "u2"),
    ]
    df = spark.createDataFrame([*rows, (None, "u3")], "text string, e string")
    out, stats = tables.content_groups_with_stats(df, entity="e")
    got = {r["text"]: r["group_id"] for r in out.collect()}
    assert got[rows[0][0]] == got[rows[1][0]] != got[rows[4][0]]
    assert got[rows[2][0]] == got[rows[3][0]] and got[None] is None
    assert got[rows[0][0]] == "g_" + hashlib.sha256(min(rows[0][0], rows[1][0]).encode()).hexdigest()[:16]
    known = tables.content_groups_with_stats(df.filter("text IS NOT NULL"), entity="e")[1]
    assert known == tables.GroupStats(3, 2, 2, 1) and stats.entity_groups == 3


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    got = {r["node"]: r["root"] for r in tables.components(spark.createDataFrame(pairs, "u int, v int")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in p for p in pairs if p[0] != p[1])}


def test_ratio_edges_against_a_plain_loop(spark):
    rng = random.Random(2)
    words = "kırmızı mavi yeşil sarı kara beyaz turuncu mor".split()
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(4, 8))) for _ in range(400)})
    token = lambda t: re.findall(r"\w+", t)

    def keys(t):
        w = token(t)
        out = {"c:" + "".join(w)} | ({"b:" + " ".join(sorted(w))} if 4 <= len(w) <= 40 else set())
        if 4 <= len(w) <= 14:
            out.add("s:" + " ".join(w))
            if len(w) >= 5:
                out |= {"s:" + " ".join(w[:k] + w[k + 1 :]) for k in range(len(w))}
        return out

    first, want = {}, set()
    for t in texts:
        for k in keys(t):
            v = first.setdefault(k, t)
            a, b = set(token(t)), set(token(v))
            if v != t and (k[0] in "cb" or len(a & b) / len(a | b) >= 0.75 or difflib.SequenceMatcher(None, v, t, autojunk=False).ratio() >= 0.75):
                want.add((t, v))
    got = tables.near_edges(spark.createDataFrame([(t,) for t in texts], "text string"), 0.75)
    assert {(r["u"], r["v"]) for r in got.collect()} == want and len(want) > 20


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_sequence_ratio_bounds(spark):
    """The decision is that of the plain ratio, ties between blocks included; the bounds are never too low."""
    rng = random.Random(4)
    pairs = [("", ""), ("", "a"), ("abcd", "bcde"), ("🤡🤡a", "a🤡"), ("ab" * 30, "ba" * 30), ("x" * 50, "x" * 41)]
    for _ in range(400):
        a = "".join(rng.choice("abc é") for _ in range(rng.randrange(1, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 8)):
            b[rng.randrange(len(b))] = rng.choice(["", "a", "bc", "é"])
        pairs.append((a, "".join(b)))
    for a, b in pairs:
        r = ratio(a, b)
        for t in (0.5, 0.75, 0.9, 1.0, r, np.nextafter(r, 2)):
            assert sequence.reaches(a, b, t) == (r >= t), (a, b, t)
    df = spark.createDataFrame([p for p in pairs if p[0] and p[1]], "v string, u string")
    for r in df.select("v", "u", sequence.length_bound(F.col("v"), F.col("u")).alias("x"), sequence.character_bound(F.col("v"), F.col("u")).alias("y")).collect():
        assert ratio(r["v"], r["u"]) <= r["y"] <= r["x"] and r["y"] == difflib.SequenceMatcher(None, r["v"], r["u"], autojunk=False).quick_ratio()
    want = sorted(p for p in pairs if p[0] and p[1] and ratio(*p) >= 0.75)
    assert sorted(map(tuple, sequence.close_pairs(df, 0.75).collect())) == want
    told = sequence.funnel(df, 0.75).first()
    assert told["pairs"] >= told["by_length"] >= told["by_characters"] >= told["close"] == len(want)
    long = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    assert sequence.reaches(long, long[:9000] + "!" + long[9000:], 0.99) and not sequence.reaches(long, long[::-1], 0.9)


def plain_groups(texts, threshold):
    """Partition of texts by a sequential table of first holders and a union-find."""
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    first = {}
    for t in sorted(texts):
        for k in text_keys(t):
            v = first.setdefault(k, t)
            a, b = set(re.findall(r"\w+", t)), set(re.findall(r"\w+", v))
            if k[0] in "cb" or len(a & b) / len(a | b) >= threshold or ratio(v, t) >= threshold:
                parent[find(t)] = find(v)
    return {frozenset(t for t in texts if find(t) == r) for r in {find(t) for t in texts}}


def text_keys(t):
    w = re.findall(r"\w+", t)
    out = {"c:" + "".join(w)} | ({"b:" + " ".join(sorted(w))} if 4 <= len(w) <= 40 else set())
    if 4 <= len(w) <= 14:
        out.add("s:" + " ".join(w))
        if len(w) >= 5:
            out |= {"s:" + " ".join(w[:k] + w[k + 1 :]) for k in range(len(w))}
    return out


def test_groups_of_batches(spark, tmp_path):
    """After each batch the groups are those of all texts at once; lesser texts that come late take a key over."""
    rng = random.Random(6)
    words = "kırmızı mavi yeşil sarı kara beyaz turuncu mor".split()
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(4, 8))) for _ in range(160)}, reverse=True)
    state = increments.Groups(spark, f"file://{tmp_path}/groups", 0.8)
    seen = []
    for k, batch in enumerate([texts[:60], texts[60:110] + texts[:5], [], texts[110:]]):
        state.add(spark.createDataFrame([(t,) for t in [*batch, None]], "text string"))
        seen = list(dict.fromkeys(seen + batch))
        held = collections.defaultdict(set)
        for r in state.groups().collect():
            held[r["group_id"]].add(r["text"])
        assert {frozenset(x) for x in held.values()} == plain_groups(seen, 0.8), k
    whole = tables.content_groups(spark.createDataFrame([(t,) for t in texts], "text string"), threshold=0.8)
    assert sorted(map(tuple, whole.select("text", "group_id").collect())) == sorted(map(tuple, state.groups().collect()))
    assert len(held) < len(texts)


def test_shared_keys(spark, tmp_path):
    """Only keys that several texts hold come with texts; repeats of a text share nothing; states keep hashes."""
    texts = ["one two three four five six", "one two three four five six", "One, two three four five six", "one two three four five", "seven eight nine ten eleven", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    held = collections.defaultdict(set)
    for r in tables.group_keys(df.distinct()).collect():
        held[r["key"]].add(r["text"])
    got = collections.defaultdict(list)
    for r in tables.shared_keys(df).collect():
        got[r["key"]].append(r["text"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in held.items() if len(v) > 1}
    assert got
    increments.Groups(spark, f"file://{tmp_path}/groups").add(df)
    assert spark.read.parquet(f"file://{tmp_path}/groups/holders").drop("batch").columns == ["n", "ks"]


def test_balanced_folds(spark):
    """Groups of mixed labels: each fold has its share of each label within one part in a hundred of all."""
    rng = random.Random(8)
    rows = [(f"g{g}", int(rng.random() < rng.choice([0.1, 0.5, 0.9])), rng.choice("aab")) for g in range(1500) for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 30]))]
    df = spark.createDataFrame([*rows, (None, 1, "a")], "group_id string, label int, kaynak string")
    out = tables.balanced_folds(df, 20, shard_groups=100)
    assert out.count() == len(rows) + 1 and out.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.count_distinct("fold").alias("n")).filter("n <> 1").count() == 0
    assert out.filter("fold IS NULL").count() == 1
    shares = out.filter("fold IS NOT NULL").groupBy("label", "kaynak").pivot("fold", list(range(20))).count().fillna(0).collect()
    for r in shares:
        counts = [r[str(k)] for k in range(20)]
        assert max(abs(c / sum(counts) - 1 / 20) for c in counts) < 0.01
    again = tables.balanced_folds(df.repartition(7), 20, shard_groups=100)
    assert out.select("group_id", "fold").distinct().exceptAll(again.select("group_id", "fold").distinct()).count() == 0
    with pytest.raises(ValueError, match="need as many"):
        tables.balanced_folds(df.filter("group_id < 'g11'"), 2000)


def test_joins_with_a_hot_text_can_be_split(spark):
    """Both sides of the join are exchanged right before it: the shape that adaptive execution splits."""
    df = spark.range(1000).selectExpr("CASE WHEN id < 400 THEN 'hot' ELSE string(id % 300) END AS text", "int(id % 2) AS label", "id AS satir_no")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (tables.quarantine(df), tables.majority(df), tables.duplicate_rows(df)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            join = plan[plan.index("Join") :]
            assert join.count("Exchange hashpartitioning") == 2 and "HashAggregate" not in join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stratified_folds(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(900)}", int(rng.random() < 0.3), rng.choice(["a", "a", "b", "rare"]) if k % 50 else "tiny") for k in range(6000)]
    df = spark.createDataFrame(rows, "group_id string, label int, kaynak string")
    out = tables.stratified_folds(df, 20, shard_groups=200).withColumn("split", tables.split_name(F.col("fold")))
    assert out.count() == 6000 and out.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    share = {(r["split"], r["label"]): r["n"] for r in out.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        total = sum(n for (_, lab), n in share.items() if lab == label)
        assert abs(share["test", label] / total - 0.15) < 0.03 and abs(share["valid", label] / total - 0.10) < 0.03
    again = tables.stratified_folds(df.repartition(7), 20, shard_groups=200)
    assert out.select("group_id", "fold").distinct().exceptAll(again.select("group_id", "fold").distinct()).count() == 0
    with pytest.raises(ValueError, match="need as many"):
        tables.stratified_folds(df.filter("group_id < 'g11'"), 20)


def test_fingerprint_is_of_a_multiset(spark):
    one = lambda rows: tables.fingerprint(spark.createDataFrame(rows, "a string, b int"), "a", "b").first()["fingerprint"]
    base = [("x", 1), ("y", None), ("x", 1)]
    assert one(base) == one(base[::-1]) != one(base[:2])
    assert len({one(r) for r in ([("x1", 1)], [("x", 11)], [(None, 1)], [("", 1)], [("n", 1)])}) == 5


def test_split_is_group_safe(spark):
    df = spark.range(3000).select(F.concat(F.lit("g"), F.col("id") % 600).alias("g")).withColumn("s", tables.split_of(F.col("g")))
    assert df.groupBy("g").agg(F.count_distinct("s").alias("n")).filter("n > 1").count() == 0
    share = {r["s"]: r["count"] / 3000 for r in df.groupBy("s").count().collect()}
    assert abs(share["test"] - 0.15) < 0.05 and abs(share["valid"] - 0.1) < 0.05
    assert tables.fold_count() == 20


def test_evaluation(spark):
    rng = random.Random(4)
    rows = [(0, round(rng.betavariate(2, 6), 4)) for _ in range(300)] + [(1, round(rng.betavariate(6, 3), 4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, p double")
    t = evaluate.select_threshold(df, 0.03).first()["threshold"]
    m = evaluate.metrics(evaluate.confusion(df, t)).first()
    assert 0.5 <= t <= 0.999 and m["fpr"] <= 0.03 and m["f1"] > 0.5
    x = spark.createDataFrame([(0, 0.02), (0, 0.1), (0, 0.35), (1, 0.7), (1, 0.9), (1, 0.99)], "label int, p double")
    assert 0.349 <= evaluate.fit_temperature(x).first()["temperature"] <= 4.001
    assert evaluate.fit_temperature(x.filter("label = 1")).first()["temperature"] == 1.0
    assert evaluate.roc_auc(x).first()["roc_auc"] == 1.0
    assert evaluate.select_threshold(spark.createDataFrame([(0, 0.9995)], "label int, p double"), 0.0).first()["threshold"] == 0.999
    warm = [r["q"] for r in x.select(evaluate.tempered(F.col("p"), 2.0).alias("q"), "p").orderBy("p").collect()]
    assert warm == sorted(set(warm)) and all(math.isfinite(q) for q in warm)
    hits = sum((p > q) + (p == q) / 2 for a, p in rows for b, q in rows if a and not b)
    assert abs(evaluate.roc_auc(df).first()["roc_auc"] - hits / (300 * 200)) < 1e-6
    odd = spark.createDataFrame([(0, -0.5), (1, 1.5), (0, 1.2), (1, 0.5)], "label int, p double")
    assert [(r["tp"], r["fp"]) for r in evaluate.curve(odd).orderBy(F.desc("p")).collect()] == [(1, 0), (1, 1), (2, 1), (2, 2)]


def test_warnings_and_bans(spark):
    df = spark.createDataFrame([(1, k, k % 2 == 0) for k in range(6)], "user_id int, seq int, is_toxic boolean")
    got = [(r["seq"], r["action"]) for r in service.warn_and_ban(df, 2).orderBy("seq").collect()]
    assert got == [(0, "warned"), (1, "passed"), (2, "banned")]


def test_state_steps():
    step = state.buffer_step()
    now, hits = [], []
    for k, c in enumerate("gavat"):
        now, hit = step(now, float(k), c)
        hits.append(hit)
    assert hits == [False] * 4 + [True] and now == []
    assert step([["g", 0.0]], 1.0, "iyi günler") == ([], False)
    now, hits = [], []
    for t, c in ((0, "p"), (20, "i"), (40, "ç")):
        now, hit = step(now, float(t), c)
        hits.append(hit)
    assert not any(hits)
    limit, now, got = state.limiter_step(1, 10.0), [], []
    for t in (0.0, 9.0, 11.0):
        now, ok = limit(now, t, "")
        got.append(ok)
    assert got == [True, False, True]


def test_batch_state_against_plain_loops(spark):
    rng = random.Random(6)
    t0 = dt.datetime(2024, 5, 1)
    rows = [(k, rng.choice([1, 2, None]), t0 + dt.timedelta(seconds=rng.randrange(4000)), rng.choice("gavtp ")) for k in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value string").repartition(5)
    for step in (state.limiter_step(3, 20.0), state.buffer_step(Lexicon(terms=("pa", "tv", "gav")))):
        want = {}
        for user in (1, 2, None):
            now = []
            for k, _, t, v in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
                now, want[user, k] = step(now, t.timestamp(), v)
        got = {(r["user_id"], r["event_id"]): r["result"] for r in state.run_batch(df, step).collect()}
        assert got == want and any(want.values()) and not all(want.values())


def test_scores_of_any_model(spark):
    from winnow.operators import ml

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    assert {r["id"]: r["p"] for r in ml.score_with(df, lambda: lambda texts: [len(t) / 10 for t in texts]).collect()} == {1: 0.3, 2: 0.0}
    words = ml.vocabulary(spark.createDataFrame([("b a b c a b",)], "text string"), min_count=2)
    assert {r["word"]: r["id"] for r in words.collect()} == {"b": 2, "a": 3}
    assert [r["ids"] for r in ml.vectorised(spark.createDataFrame([("a x B",), (None,)], "text string"), words, length=4).collect()] == [[3, 1, 2, 0], [0, 0, 0, 0]]
    with pytest.raises(ValueError, match="both labels"):
        ml.run_training(spark.createDataFrame([("train", 1, "a")], "split string, label int, text string"), [], dry_run=True)


def _streamed(spark, tmp_path, name, parts, step, **options):
    schema = "event_id long, user_id long, ts timestamp, value string"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-part{k}"))
        (tmp_path / name).mkdir(exist_ok=True)
        source = next((tmp_path / f"{name}-part{k}").glob("*.parquet"))
        target = tmp_path / name / f"{k}.parquet"
        source.rename(target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = state.run_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)), step, **options)
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r["k"], r["o"]): r["result"] for r in spark.table(name).collect()}


def test_stream_equals_batch_with_events_out_of_order(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, k % 3, t0 + dt.timedelta(seconds=7 * k), "x") for k in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value string")
    step = state.limiter_step(2, 60.0)
    batch = {(r["user_id"], r["event_id"]): r["result"] for r in state.run_batch(df, step).collect()}
    rng = random.Random(5)
    mixed = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 8))  # at most a minute late
    parts = [mixed[k : k + 30] for k in range(0, 120, 30)] + [[(999, 99, t0 + dt.timedelta(hours=3), "x")]]
    got = _streamed(spark, tmp_path, "ordered", parts, step, delay="70 seconds")
    assert {k: v for k, v in got.items() if k[0] < 3} == batch


def test_stream_drops_what_is_later_than_the_watermark(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda k, s: (k, 1, t0 + dt.timedelta(seconds=s), "x")
    parts = [[at(1, 0), at(2, 600)], [at(3, 605)], [at(4, 1), at(5, 610)], [at(6, 9000)]]
    got = _streamed(spark, tmp_path, "late", parts, state.limiter_step(1, 2.0), delay="10 seconds")
    assert {o for _, o in got} == {1, 2, 3, 5}


def _put(spark, folder, rows, name):
    """One file of a streamed folder; names order the files."""
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, text string, verdict string").coalesce(1).write.mode("append").parquet(f"{folder}-{name}")
    folder.mkdir(exist_ok=True)
    for source in type(folder)(f"{folder}-{name}").glob("*.parquet"):
        source.rename(folder / f"{name}.parquet")


def test_gate_as_stream_with_restart_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, k % 4, t0 + dt.timedelta(seconds=5 * k), rng.choice(["p", "a", "x", "iyi"]), rng.choice(["clean"] * 6 + ["toxic", "review", None])) for k in range(240)]
    last = [(900 + u, u, t0 + dt.timedelta(days=9), "x", "clean") for u in range(5)]  # long after all states but the warnings went
    end = [(999, 99, t0 + dt.timedelta(days=20), "x", "clean")]
    step = state.gate_step(state.window_step(4, 120), state.buffer_step(Lexicon(terms=("pa",)), 60.0), 3)
    schema = "event_id long, user_id long, ts timestamp, text string, verdict string"
    bad = [(2000, None, t0, "x", "clean"), (2001, 1, None, "x", "clean")]
    batch = {r["event_id"]: r["result"] for r in state.moderation_gate(spark.createDataFrame(rows + last + bad, schema), step).collect()}
    assert set(batch.values()) == {"limited", "forbidden", "banned", "warned", "passed", "queued_for_review", "unavailable"}

    mixed = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 8))
    for name, parts in (("a", [mixed[:120]]), ("b", [mixed[120:] + bad, last, end])):  # the second start goes on from the checkpoint
        for k, part in enumerate(parts):
            _put(spark, tmp_path / "in", part, f"{name}{k}")
            stream = state.moderation_gate(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), step, delay="70 seconds", idle_seconds=3600.0)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
    got = [(r["event_id"], r["result"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert dict(x for x in got if x[0] != 999) == batch and len({k for k, _ in got}) == len(got)
    assert batch[900 + max(u for u in range(4) if any(batch[r[0]] == "banned" for r in rows if r[1] == u))] == "forbidden"


def test_window_step_equals_window_function(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 5, 1)
    rows = [(k, rng.choice([1, 2]), t0 + dt.timedelta(seconds=rng.randrange(900)), "") for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value string")
    want = {r["event_id"]: r["accepted"] for r in state.fixed_window_limit(df, 5, 60).collect()}
    assert {r["event_id"]: r["result"] for r in state.run_batch(df, state.window_step(5, 60)).collect()} == want


def test_registry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    for name in ("metrics", "ndg_jaccard_edges", "warning_ban", "normalize_document"):
        assert names[name](spark, "/root/testdata/sf0.001").count() > 0


def test_word_vectors_are_learned_by_as_many_tasks_as_run_at_once(spark):
    from winnow.operators import ml

    texts = spark.range(8 * ml.LEARNER_ROWS).selectExpr("concat('a b c', id % 7, ' d') AS text")
    assert ml.word2vec(texts, size=4, min_count=1, epochs=1).getNumPartitions() == spark.sparkContext.defaultParallelism == 8
    few = texts.limit(3 * ml.LEARNER_ROWS)
    assert ml.word2vec(few, size=4, min_count=1, epochs=1).getNumPartitions() == ml.LEARNERS
    assert ml.word2vec(few, size=4, min_count=1, epochs=1, partitions=2).getNumPartitions() == 2


def test_word_vectors_stay_in_tables(spark, monkeypatch):
    import numpy as np
    from pyspark.ml import feature

    from winnow.operators import ml

    monkeypatch.setattr(feature, "Word2Vec", None)  # its driver holds the whole vocabulary
    topics = [[f"{t}{k}" for k in range(8)] for t in "ab"]
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(topics[k % 2]) for _ in range(12)),) for k in range(3000)] + [("Rare rare",), ("once",), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    model = ml.word2vec(df, size=8, min_count=2, epochs=5)
    found = {r["word"]: np.array(r["vector"].toArray()) for r in model.getVectors().collect()}
    assert set(found) == {w for t in topics for w in t} | {"rare"}
    near = lambda x, y: float(found[x] @ found[y] / np.linalg.norm(found[x]) / np.linalg.norm(found[y]))
    assert min(near("a0", w) for w in topics[0]) > max(near("a0", w) for w in topics[1])
    again = {r["word"]: list(r["vector"].toArray()) for r in ml.word2vec(df, size=8, min_count=2, epochs=5).getVectors().collect()}
    assert {w: v.tolist() for w, v in found.items()} == again
    words = ml.vocabulary(df, min_count=2, most=10)
    assert sorted(r["id"] for r in ml.embedding_rows(model, words).collect()) == list(range(10))
