"""Byte-level encoding, threshold search and token alignment against plain loops over the libraries."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from winnow.llm import byte_bpe, queries, threshold_search, token_alignment
from winnow.llm import units as U

SCHEMA = "doc_id long, text string, ids string, start int, pair string"
ODD = [
    None, "", " ", "  ", "\n", "a", " a ", "a  b", "don't 'll' it's\n\n  x", "\t\tx  \n y", "a  b　 c    d", "x\x1c y\x1f\x1f z", "A1b2 33 İstanbul ſ é ß",
    "▁ under", "a ▁", "\x00 nul \x00", "ﬁ ① ½", "<|endoftext|> <s> </s> <0x41> [UNK]", "漢字かな交じり文 emoji 🤡🤡 x", "é ́ x", "''' ''ll 'lll ' s", "a" * 900 + " " * 900 + "-" * 900 + "\n" * 50 + "b" * 40,
]


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("alpha Beta gämma δelta it's 12 3.5 x-y … \n \t".split(" ")) + rng.choice(["", "", str(rng.randrange(50)), "!", "'ll", "\n"])
    rows = [(k, (" " * rng.randrange(1, 3)).join(word() for _ in range(rng.randrange(1, 200)))) for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(ODD)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None)]
    return [(*r, "clash", 1, "clash") for r in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(map(tuple, rows))


def plain_encoding():
    path, pattern = byte_bpe.default_files()
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (64, 24)])
def test_byte_bpe(spark, docs, chunk, overlap):
    model = plain_encoding()
    want = counted((d, tuple(model.encode_ordinary(t or "")), 1) for d, t, *_ in ROWS)
    ids = byte_bpe.encode(docs, *byte_bpe.default_files(), carry=("start",), chunk=chunk, overlap=overlap)
    got = counted((r.doc_id, tuple(r.ids), r.start) for r in ids.collect())
    assert got == want
    back = byte_bpe.decode(ids, *byte_bpe.default_files()).collect()
    assert counted((r.doc_id, bytes(r.bytes)) for r in back) == counted((d, (t or "").encode()) for d, t, *_ in ROWS)


def test_byte_bpe_parts_and_errors(spark, empty):
    files = byte_bpe.default_files()
    assert byte_bpe.encode(empty, *files).collect() == [] and byte_bpe.decode(empty.select(F.array().cast("array<int>").alias("ids"), "doc_id"), *files).collect() == []
    half = spark.createDataFrame([(1, plain_encoding().encode_ordinary("漢")[:1]), (2, None), (2, [])], "doc_id long, ids array<int>")
    got = {(r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(half, *files).collect()}
    assert (2, b"") in got and any(d == 1 and b and "漢".encode().startswith(b) for d, b in got)
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), *files).collect()


def test_byte_bpe_long(spark):
    """Runs far longer than an overlap: neighbours that never meet become one chunk."""
    texts = ["a" * 300_000, " " * 300_000, "a1" * 100_000, " \n" * 100_000 + "x", "word " * 60_000]
    texts += [f"tail {t} end" for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.ids for r in byte_bpe.encode(rows, *byte_bpe.default_files()).collect()}
    model = plain_encoding()
    assert got == {k: model.encode_ordinary(t) for k, t in enumerate(texts)}


def test_units_join_to_the_text():
    texts = [t for _, t, *_ in ROWS if t]
    units, starts = U.cut(U.plain(pa.array(texts)))
    parts = [b.decode() for b in units.to_pylist()]
    assert ["".join(parts[a:b]) for a, b in zip(starts, starts[1:])] == texts
    memory = U.Memory(lambda x: (np.array([len(u) for u in x]), np.ones(len(x), np.int64)), limit=5)
    for _ in range(3):
        flat, _ = U.encoded(memory, units, starts)
        assert flat.tolist() == [len(p) for p in parts]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(rows, items, k=10):
    held = [(d, collections.Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    many, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall((t or "").translate(FOLD)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * many) // total
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return counted(out)


def test_threshold_search(spark, docs, empty):
    rng = random.Random(9)
    texts = [(d, t) for d, t, *_ in ROWS]
    items = [(k, " ".join(rng.choice(texts)[1] or "x" for _ in range(2))[:200]) for k in range(15)]
    items += [(20, None), (21, "  ..."), (22, "nowhere-to-befound"), (None, "alpha"), (3, "alpha12 Alpha ALPHA"), (23, "alpha")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    for sizes in ({}, {"shard_rows": 4}, {"shard_bytes": 300, "block_terms": 20}, {"k": 2, "shard_rows": 1}):
        got = threshold_search.search(docs, asked, **sizes)
        assert counted(got.select("item_id", "rank", "doc_id", "score").collect()) == plain_search(texts, items, sizes.get("k", 10))
    assert threshold_search.search(empty, asked).collect() == []
    assert threshold_search.search(docs, asked.limit(0)).collect() == []


def test_threshold_stops_early():
    """A query that one rare term decides does not walk its long list."""
    n = 5000
    first, doc = np.array([0, n, n + 20]), np.concatenate([np.arange(n), np.arange(20)]).astype(np.int32)
    times = np.ones(n + 20, np.int32)
    shard = threshold_search.Shard(np.array([0, 1]), first, doc, times, np.full(n, 50), np.array([3, 9000]), n, 50 * n)
    docs, scores = shard.top(np.array([0, 1]), 10, 0, np.arange(n))
    assert docs.tolist() == list(range(10)) and len(set(scores.tolist())) == 1
    assert shard.walked < n / 4


def plain_alignment(rows):
    a_path, b_path = token_alignment.default_files()
    a_model = Tokenizer.from_file(a_path)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=b_path)
    letters = token_alignment._byte_letters()
    out, held = [], collections.Counter()
    for d, t in rows:
        row = [d, [], [], [], ""]
        if t:
            a = a_model.encode(" " + t, add_special_tokens=False).ids
            b = b_model.encode(t)
            a_bytes = [bytes(letters[c] for c in a_model.id_to_token(k)) for k in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
                spans = []
                for parts in (a_bytes, b_bytes):
                    at, ends = 0, []
                    for p in parts:
                        ends.append((at, at + len(p)))
                        at += len(p)
                    spans.append(ends)
                links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e]
                cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                groups, lo = [], 0
                for c in cuts:
                    groups.append(",".join(str(k) for k, (s, e) in zip(a, spans[0]) if lo <= s and e <= c) + "|" + ",".join(str(k) for k, (s, e) in zip(b, spans[1]) if lo <= s and e <= c))
                    lo = c
                row = [d, a, b, links, ";".join(groups)]
                held.update({(a[i], b[j]) for i, j in links})
        out.append(row)
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows, digests = [], []
    for d, a, b, links, groups in out:
        rows.append((d, tuple(a), tuple(b), tuple(links), groups))
        n = [held[a[i], b[j]] for i, j in links]
        best_n = sum(held[a[i], b[j]] == best[a[i]] for i, j in links)
        digests.append((d, len(a), len(b), groups.count("|"), len(links), best_n, sum(n), hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    return counted(rows), counted(digests)


def test_token_alignment(spark, docs, empty):
    files = token_alignment.default_files()
    whole, digests = plain_alignment([(d, t) for d, t, *_ in ROWS])
    got = counted((r.doc_id, tuple(r.a_ids), tuple(r.b_ids), tuple((x.a, x.b) for x in r.links), r.groups) for r in token_alignment.align(docs, *files).collect())
    assert got == whole
    for sizes in ({}, {"shard_rows": 3, "shard_bytes": 500}):
        assert counted(token_alignment.link_scores(docs, *files, **sizes).collect()) == digests
    assert token_alignment.align(empty, *files).collect() == [] and token_alignment.link_scores(empty, *files).collect() == []


def test_owners_in_windows():
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 9, 400), rng.integers(1, 5, 2000)
    b = np.append(b, max(a.sum() - b.sum(), 1))
    a = np.append(a, max(b.sum() - a.sum(), 1)) if a.sum() < b.sum() else a
    b = np.append(b, a.sum() - b.sum()) if b.sum() < a.sum() else b
    want = token_alignment.owner_changes(a, b)
    for owned in (1, 7, 64):
        assert all((x == y).all() for x, y in zip(want, token_alignment.owner_changes(a, b, owned)))


def test_long_text_alignment(spark):
    text = "x" * 50_000 + " word" * 30_000
    rows = spark.createDataFrame([(1, text), (2, text), (3, "word")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_alignment.link_scores(rows, *token_alignment.default_files()).collect()}
    assert got[1].groups_sha256 == got[2].groups_sha256 and got[1].n_links >= max(got[1].n_a, got[1].n_b) and got[3].count_sum == 3 * got[3].n_links


def test_queries_of_tokens(spark):
    """The queries over whole tables give the digests of the libraries."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = plain_encoding()
    want = {}
    for d, t in rows:
        ids = model.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.queries()["op11_byte_bpe"](spark, sf).collect()} == want
    short = [(d, t) for d, t in rows if len(t or "") < 3000]
    got = token_alignment.link_scores(spark.createDataFrame(short, "doc_id long, text string"), *token_alignment.default_files())
    assert counted(got.collect()) == plain_alignment(short)[1]
