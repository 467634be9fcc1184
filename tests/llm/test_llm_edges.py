"""Null ids, clashing columns, and parts of the operators that the other file does not hold against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from winnow.llm import components, jaccard_join, line_dedup, lm_scoring, members, mixing, packing, quality_rules, substring_dedup, tables, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words string, taken int"
SHARED = "one line that three documents and more do share"


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("ash birch cedar elm fir hazel larch maple oak pine".split()) + str(rng.randrange(40))
    passage = " ".join(word() for _ in range(50))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(60, 200))), f"s{k % 4}") for k in range(40)]
    rows += [(50 + k, f"{SHARED}\n{passage} {word()} {word()}\n{' '.join(word() for _ in range(60))}", "s1") for k in range(4)]
    rows += [(None, f"{SHARED}\n{rows[3][1]}", "s0"), (None, f"{SHARED}\n{rows[3][1]}", None), (None, None, None), (None, "", "s2"), (60, None, None), (61, " \n ", "s3")]
    rows += [(7, rows[7][1], "s3"), (7, rows[7][1], "s3"), (8, "another text for the same id", "s0")]
    return [(*r, "x", 5) for r in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")


def test_line_dedup_of_null_ids(docs):
    holders = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        for line in (t or "").split("\n"):
            if i is not None:
                holders[line.strip().lower()].add(i)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(x.strip()) < 20 or len(holders[x.strip().lower()]) < 3 or max(holders[x.strip().lower()]) == i]
        want[i, len(lines), "\n".join(kept)] += 1
    got = line_dedup.line_dedup(docs, carry=("source",)).collect()
    assert want == collections.Counter((r["doc_id"], r["n_lines"], r["kept_text"]) for r in got)


def test_bands_against_a_plain_loop(docs):
    bands = quality_rules.Bands(below=(300, 700), low=(1.0, 1.4, 1.6), high=(2.2, 2.4, 2.6), chunk_bytes=256, chunk_low=1.3, chunk_high=2.3, max_bad_share=0.3)
    squeeze = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    limits = lambda n: (1.0, 2.2) if n < 300 else (1.4, 2.4) if n < 700 else (1.6, 2.6)
    rng = random.Random(5)
    texts = [t for _, t, *_ in ROWS] + ["".join(rng.choice("abcdefghij klmnop") for _ in range(900)), "ha " * 300, "é" * 400 + " end"]
    df = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df, bands=bands).collect()}
    verdicts = collections.Counter()
    for k, t in enumerate(texts):
        data = (t or "").encode()
        bad = 0
        if len(data) > 256:
            for at in range(0, len(data), 256):
                part = data[at : at + 256]
                low, high = (1.3, 2.3) if len(part) == 256 else limits(len(part))
                bad += len(part) * (not low <= squeeze(part) <= high)
        ratio = squeeze(data) if data else 0.0
        fine = bool(data) and limits(len(data))[0] <= ratio <= limits(len(data))[1] and bad / max(len(data), 1) <= 0.3
        r = got[k]
        assert abs(r["ratio"] - ratio) < 1e-9 and abs(r["bad_chunk_share"] - (bad / len(data) if data else 0.0)) < 1e-9
        assert r["kept"] == (fine and not r["base_failed"])
        verdicts[r["kept"]] += 1
    assert verdicts[True] > 5 and verdicts[False] > 5


def test_packing_places_nearly_all_by_the_rule():
    """Remainders of real lengths; a remainder that lies whole in a window with others was placed by the rule."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text").combine_chunks()
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    counts = []
    for lo in range(0, len(texts), 2000):
        counts += (np.diff(tokenizer.encode(texts[lo : lo + 2000])[1]) + 1).tolist()
    rest = [n % 2048 for n in counts if n % 2048]
    rng = random.Random(1)
    rng.shuffle(rest)
    for lengths, least in ((rest, 0.85), (rest * 4, 0.95)):
        state = packing.SumOfSquares(2048)
        for item, length in enumerate(lengths):
            state.place(item, length)
        chosen = {item: k for k, w in enumerate(state.windows) for item in w}
        kept = 0
        sequences = packing.pack_shard(lengths, 2048)
        for sequence in sequences:
            homes = collections.Counter()
            for item, start, n in sequence:
                homes[chosen[item]] += n
            kept += max(homes.values())
        assert kept >= least * sum(lengths), kept / sum(lengths)
        assert all(sum(n for _, _, n in s) in (2048, *(1 << k for k in range(11))) for s in sequences)
        assert sum(n for s in sequences for _, _, n in s) == sum(lengths)


def test_packing_of_null_and_repeated_ids(docs):
    got = packing.pack(docs, packing.default_tokenizer(), window=128, shard_rows=20).collect()
    tok = packing.WordTokenizer(packing.default_tokenizer()).tokenizer
    want = collections.Counter()
    for i, t, *_ in ROWS:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    have = collections.Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want
    again = packing.pack(docs.repartition(7), packing.default_tokenizer(), window=128, shard_rows=20).collect()
    assert collections.Counter(got) == collections.Counter(again)


def test_mixing_against_a_plain_loop(docs):
    block_tokens, shard_rows, seed = 16, 9, 17
    got = mixing.mix(docs, block_tokens=block_tokens, least_blocks=50, shard_rows=shard_rows).collect()
    x = docs.select("doc_id", "source", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("o"))
    x = x.withColumn("m", F.xxhash64(F.lit(seed + 1), "o"))
    rows = [(r["doc_id"], r["source"], len(words(r["text"])), r["o"], r["m"]) for r in x.collect()]
    names = sorted({r[1] for r in rows if r[1] is not None}) + ([None] if any(r[1] is None for r in rows) else [])
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), 1.5 * sum(size.values())
    free = set(names)
    while free:  # one round of shares, the over-full ones stop at their cap
        share = {s: left * weight[s] / sum(weight[n] for n in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left, free = left - sum(2.0 * size[s] for s in over), free - over
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
    block = max(1, min(block_tokens, sum(size.values()) // 50))

    def seats(votes, many, most):
        held = [0] * len(votes)
        for _ in range(min(many, sum(m for m, v in zip(most, votes) if v > 0))):
            k = max((j for j in range(len(votes)) if held[j] < most[j] and votes[j] > 0), key=lambda j: (votes[j] / (2 * held[j] + 1), -j))
            held[k] += 1
        return held

    blocks = lambda n: max(1, round(n / block)) if n else 0
    own = dict(zip(names, seats([target[s] for s in names], round(sum(target.values()) / block), [2 * blocks(size[s]) for s in names])))
    want = collections.Counter()
    for s in names:
        mine = [r for r in rows if r[1] == s]
        shards = max(1, -(-len(mine) // shard_rows))
        cells = sorted({r[4] % shards for r in mine})
        tokens = [sum(r[2] for r in mine if r[4] % shards == c) for c in cells]
        quota = seats([float(t) for t in tokens], own[s], [2 * blocks(t) for t in tokens])
        for c, t, q in zip(cells, tokens, quota):
            n = blocks(t)
            step = next((p for p in mixing.STEPS if n and np.gcd(p, n) == 1), 1)
            times = [q // n + ((b * (step % n) + seed) % n < q % n) for b in range(n)]
            at = 0
            # equal rows may stand in any order
            for r in sorted((r for r in mine if r[4] % shards == c), key=lambda r: (r[3], r[0] is not None, r[0] or 0)):
                want[r[0], s, sum(times[((at + k + 1) * n - 1) // t] for k in range(r[2]))] += 1
                at += r[2]
    assert want == collections.Counter((r["doc_id"], r["source"], r["taken"]) for r in got)


def test_null_ids_elsewhere(docs):
    jaccard = jaccard_join.jaccard_classes(docs).collect()
    assert collections.Counter(r["doc_id"] for r in jaccard) == collections.Counter(r[0] for r in ROWS)
    assert all(r["component_id"] is None for r in jaccard if r["doc_id"] is None)
    repeats = substring_dedup.remove_repeats(docs, shard_rows=7).collect()
    c = collections.Counter(tuple(w[k : k + 35]) for _, t, *_ in ROWS for w in [words(t)] for k in range(len(w) - 34))
    want = collections.Counter()
    for i, t, *_ in ROWS:
        w = words(t)
        gone = {k + d for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for d in range(35)}
        want[i, len(w), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert want == collections.Counter((r["doc_id"], r["n_words"], r["kept_text"]) for r in repeats)
    scored = lm_scoring.lm_scores(docs).collect()
    assert len(scored) == len(ROWS) and not any(r["held_out"] for r in scored if r["doc_id"] is None)
    assert len({round(r["score"], 6) for r in scored if r["doc_id"] == 7}) == 1
    found = topk_search.search(docs, docs.filter("doc_id IS NULL OR doc_id = 3")).collect()
    assert {r["query_id"] for r in found} == {3} and all(r["doc_id"] is not None for r in found)


def test_members_never_say_no_to_a_member(spark):
    rng = np.random.default_rng(3)
    inside, outside = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(2))
    bits = members.bitmap(spark.createDataFrame(pa.table({"h": pa.array(inside)}).to_pandas()), "h").value
    assert members.may_hold(bits, inside).all() and members.may_hold(bits, outside).mean() < 0.01
    assert not members.may_hold(members.bitmap(spark.createDataFrame([], "h long"), "h").value, outside).any()


def test_components_discard_their_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "u int, v int")
    got = {r["u"]: r["v"] for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 101: 100}


def test_no_compressed_table_is_sent_whole_through_the_driver(spark):
    # 0.6 MB as a file, over 25 MB as a hash table
    edges = tables.materialize(spark.range(600_000).select((F.col("id") * 3).alias("u"), (F.floor(F.col("id") / 50) * 150).alias("v")))

    def plan():
        return spark.range(2_400_000).join(edges, F.col("id") == F.col("u"), "left")._jdf.queryExecution().toString()

    before = spark.conf.get(tables.BROADCAST)
    assert "BroadcastHashJoin" in plan()
    with tables.bounded(spark):
        assert "BroadcastHashJoin" not in plan()
        assert int(spark.conf.get(tables.BROADCAST)) == tables.BROADCAST_BYTES
    assert spark.conf.get(tables.BROADCAST) == before
    spark.conf.set(tables.BROADCAST, "-1")
    try:
        with tables.bounded(spark):
            assert spark.conf.get(tables.BROADCAST) == "-1"
    finally:
        spark.conf.set(tables.BROADCAST, before)
    tables.discard(edges)


def test_tables_are_shared_or_refused(spark, monkeypatch):
    written = tables.materialize(spark.range(5))
    path = tables._WRITTEN[written]
    assert written.count() == 5
    tables.discard(written)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session)


def test_pipeline_against_plain_stages(spark, docs):
    import corpus_pipeline

    near = max((r for r in ROWS[:40] if r[0] > 8), key=lambda r: len(r[1]))
    more = [(70 + k, near[1] + f" tail{k}", "s1", "x", 5) for k in range(3)] + [(80, None, None, "x", 5)]
    rows = ROWS + more
    own = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'en' AS lang", "source", "1L AS n_chars", "taken AS extra")
    bands, squeeze = quality_rules.Bands(), zstandard.ZstdCompressor(level=3)

    def good(t):
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
        return len(w) >= 50 and 100 * len(cover) <= 50 * len(w) and bands.verdict((t or "").encode(), squeeze)[2]

    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality rules"](spark, own, "").persist()
    texts = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert texts(one) == collections.Counter((i, t) for i, t, *_ in rows if good(t))
    two = stages["line dedup"](spark, one, "").persist()
    holders = collections.defaultdict(set)
    for (i, t) in texts(one):
        for x in t.split("\n"):
            if i is not None:
                holders[x.strip().lower()].add(i)
    drop = lambda i, x: len(x.strip()) >= 20 and len(holders[x.strip().lower()]) >= 3 and max(holders[x.strip().lower()]) != i
    left = collections.Counter()
    for (i, t), n in texts(one).items():
        kept = "\n".join(x for x in t.split("\n") if not drop(i, x))
        left[i, kept] += n if words(kept) else 0
    assert texts(two) == +left
    three = stages["n-gram Jaccard join"](spark, two, "").persist()
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, t in left for w in [words(t.lower())] if i is not None]
    root = {i: i for i, _ in sets}
    for _ in root:
        for a, s in sets:
            for b, u in sets:
                if s and u and 100 * len(s & u) >= 80 * len(s | u):
                    root[a] = root[b] = min(root[a], root[b])
    want = collections.Counter({(i, t): (n if i is None else 1) for (i, t), n in left.items() if n and (i is None or root[i] == i)})
    assert texts(three) == want and sum(i in (near[0], 70, 71, 72) for i, _ in want) == 1 and sum(i in (near[0], 70, 71, 72) for i, _ in texts(two)) == 4
    four = stages["mixing"](spark, three, "").persist()
    sizes = collections.Counter(r["source"] for r in three.collect() for _ in words(r["text"]))
    taken = collections.Counter(r["source"] for r in four.collect() for _ in words(r["text"]))
    assert abs(sum(taken.values()) - min(1.5 * sum(sizes.values()), 2 * sum(sizes.values()))) < 10 * len(sizes)
    assert all(taken[s] <= 2 * sizes[s] for s in sizes) and four.columns == list(corpus_pipeline.COLUMNS)
    five = stages["packing"](spark, four, "").collect()
    tok = packing.WordTokenizer(packing.default_tokenizer()).tokenizer
    tokens = collections.Counter()
    for r in four.collect():
        tokens[r["doc_id"]] += len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
    have = collections.Counter()
    for r in five:
        have[r["doc_id"]] += r["length"]
    assert have == tokens and zlib.crc32(b"") == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
