import difflib
import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from winnow.functions import rules, text
from winnow.plans import texts


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_document_golden(spark):
    value = "BU, aslında çok güzel!!! Ama @USER kötü değil. https://example.com"
    assert one(spark, value, text.for_document) == "çok güzel kötü değil"


def test_model_form(spark):
    got = one(spark, "@ayse_k HARIKAAA 🐍 www.ornek.org/x rt #Gündem", text.for_model)
    assert got == "kullanici harikaa yılan url gündem"
    assert one(spark, None, text.for_model) == ""
    assert one(spark, "2024!", text.for_model) == "2o2ai"


def test_label_parsing(spark):
    cases = {"-1": 1, "1,0": 1, "1e0": 1, "inf": None, "label_1": 1, "not-toxic": 0, "2": None, "Evet": 1, None: None}
    for value, want in cases.items():
        assert one(spark, value, text.parse_label) == want, value


def test_truncation(spark):
    assert one(spark, "abc def ghi", lambda c: text.truncated(c, 7)) == "abc"
    assert one(spark, "abcdefghijk", lambda c: text.truncated(c, 7)) == "abcdefg"
    assert one(spark, "abc", lambda c: text.truncated(c, 7)) == "abc"


def test_reject_reason_order(spark):
    df = spark.createDataFrame([(None, 1, "yes"), ("x", None, "no"), ("x", 1, "no"), ("x", 1, None), ("a b", 1, "yes")], "t string, l int, a string")
    got = [r["r"] for r in df.select(text.reject_reason(F.col("t"), F.col("l"), F.col("a"), 2).alias("r")).collect()]
    assert got == ["empty_after_normalization", "invalid_label", "annotator_disagreement", "too_short", None]


def test_rules(spark):
    harmless = ("Pazardan taze sebze aldık.", "Sıkı bir program hazırladık.", "Dalgalı denizde yüzdüler.", "Ahmakça bir plandı.", "gerzek", None)
    for value in harmless:
        assert one(spark, value, rules.dictionary_hit) is False, value
    for value in ("p i ç", "g-a-v-a-t", "k@lt@k mı", "piiiiç kurusu", "1 gerzek"):
        assert one(spark, value, rules.full_hit) is True, value
    names = {"p i ç": "spaced", "yavşak": "hard_term", "4lç4k": "leet", "seni öldürürüm": "phrase", "temiz": None}
    for value, want in names.items():
        assert one(spark, value, rules.first_rule) == want, value


def test_opt_in_rules(spark):
    assert one(spark, "c\u0327a\u200bğ\u00adı", rules.plain_unicode) == "cagı"
    assert one(spark, "gavta", rules.unswapped) == "gavat" and one(spark, "tavag", rules.unswapped) == "tavag"
    assert one(spark, "kelime", rules.stem) == "kelime"
    assert one(spark, "a🐷b", rules.emojis_as_words) == "a domuz b"
    near = rules.nearest_term()
    got = spark.createDataFrame([("pezevenkk",), ("gül",), (None,), ("gerizekali",)], "t string").select("t", near(F.col("t")).alias("n")).collect()
    assert [(r["n"]["term"], r["n"]["score"]) for r in got] == [("pezevenk", 94), (None, None), (None, None), ("gerizekalı", 90)]


def test_invisible_characters_and_blanks(spark):
    assert one(spark, "a\u200b\u2060b\u00a0\u3000c", text.for_model) == "ab c"


def test_hmac(spark):
    want = hmac.new(b"key", "größe".encode(), hashlib.sha256).hexdigest()
    assert one(spark, "größe", lambda c: text.hmac_sha256(c, b"key")) == want


def test_forms_begin_where_plain_patterns_do(spark):
    """Patterns told by their first character match what those without do; texts of many rows keep order and nulls."""
    pieces = ["a", "R", "rt", "RT", "ı", "İ", "ſ", "K", "ß", "@", "@ab.c", "#", "##ğ1", "--", "-", "'", "_", " ", "\x85", " ", "\n", "www.", "WWW.x", "htTps://", "é", "é", "ﬁ", "😀", "​", "𝒜", "½", "1"]
    rows = [(k, "".join(pieces[(k * 31 + j * j * (k % 13 + 1)) % len(pieces)] for j in range(k % 9 + 3))) for k in range(700)]
    df = spark.createDataFrame([*rows, (700, None)], "k int, t string").coalesce(1)
    w, b = text.WORD, text.BLANK

    def links(c):
        return F.regexp_replace(F.regexp_replace(c, rf"(?i)(?:https?://|www\.)[^{b}]+", " url "), rf"(?<![{w}@])@[{w}.]{{2,}}(?![{w}@])", " kullanici ")

    def model(c):
        c = text.nfkc(F.regexp_replace(F.coalesce(c, F.lit("")), text.fixed.INVISIBLE, ""))
        for emoji, words in text.fixed.EMOJIS.items():
            c = F.replace(c, F.lit(emoji), F.lit(f" {words} "))
        c = F.regexp_replace(F.regexp_replace(links(c), rf"(?<![{w}])#([{w}]+)", "$1"), rf"(?i)(?<![{w}])rt(?![{w}])", " ")
        c = F.translate(F.lower(c), text.fixed.MODEL_LEET_FROM, text.fixed.MODEL_LEET_TO)
        return F.trim(F.regexp_replace(F.regexp_replace(c, r"([^\n])\1{2,}", "$1$1"), f"[{b}]+", " "))

    def document(c):
        c = F.regexp_replace(links(F.coalesce(c, F.lit(""))), rf"(?<![{w}])[^{w}{b}]+|[^{w}{b}]+(?![{w}])", " ")
        c = F.regexp_replace(F.lower(model(c)), rf"(?iu)[^0-9a-zçğıöşü{b}]", " ")
        return F.array_join(F.filter(F.split(c, f"[{b}]+"), lambda x: (x != "") & ~x.isin(*text.fixed.STOPWORDS)), " ")

    t = F.col("t")
    got = df.select("k", text.nfkc(t).alias("n"), text.for_model(t).alias("m"), text.for_document(t).alias("d"), model(t).alias("pm"), document(t).alias("pd")).collect()
    assert [r["n"] for r in got] == [*(unicodedata.normalize("NFKC", x) for _, x in rows), None]
    assert all(r["m"] == r["pm"] and r["d"] == r["pd"] for r in got)


def test_queries_of_forms_spread_one_row_group(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("normalize_model", "normalize_document"):
        plan = texts.QUERIES[name][0](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" in plan, name


def test_nearest_term_reads_few_pairs(spark, monkeypatch):
    """The bounds leave few pairs to be read, and the same terms as reading all."""
    lexicon = rules.Lexicon(terms=("idiot", "idiots", "loser", "moron", "scumbag"), contextual=(), phrases=())
    words = ["idiot", "idiotx", "idoit", "losers", "loserr", "moro", "scumbga", "scumbags", "abcde", "nothing", "xxxxx"]

    def plain(word):
        found = (None, 0)
        for term in lexicon.terms:
            if abs(len(word) - len(term)) <= 2 and (r := round(100 * difflib.SequenceMatcher(None, word, term).ratio())) > found[1]:
                found = (term, r)
        return found if found[1] >= 90 else (None, None)

    run = rules.nearest_term(lexicon).func
    read = []
    monkeypatch.setattr(difflib.SequenceMatcher, "get_matching_blocks", lambda self, own=difflib.SequenceMatcher.get_matching_blocks: (read.append(1), own(self))[1])
    got = run(pd.Series(words))
    many = len(read)
    assert many < len(words)
    assert [(t, None if s is pd.NA else int(s)) for t, s in zip(got["term"].where(got["term"].notna(), None), got["score"], strict=True)] == [plain(w) for w in words]
