"""Queries of normal forms and moderation rules, with SQL that needs no look-around or back-reference."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from winnow.functions import fixed, lexicon_sets, rules, text
from winnow.operators import fuzzy, moderation, service, tables
from winnow.plans.base import L, M, TEST_LEXICON, Query, labelled, messages, read, spread
from winnow.sources import csv

W = r"\p{L}\p{N}_"
BLANK = r" \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{BLANK}]+', ' ', 'g'))"


def _runs(x: str, most: int) -> str:
    """x with runs of one character (but the newline) cut to most characters."""
    same = " AND ".join(f"c = chars[i - {k}]" for k in range(1, most + 1))
    return f"(SELECT array_to_string(list_filter(chars, lambda c, i: NOT (i > {most} AND c <> chr(10) AND {same})), '') FROM (SELECT string_split({x}, '') AS chars))"


def _links(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)(https?://|www\\.)[^{BLANK}]+', ' url ', 'g')"
    for _ in range(2):  # neighbours share the character between them
        x = f"regexp_replace({x}, '(^|[^{W}@])@[{W}.]{{2,}}($|[^{W}@.])', '\\1 kullanici \\2', 'g')"
    return x


def model_sql(x: str) -> str:
    """Normal form for models, for texts that NFKC leaves alone."""
    x = f"regexp_replace(coalesce({x}, ''), '{_re2(fixed.INVISIBLE)}', '', 'g')"
    for emoji, words in fixed.EMOJIS.items():
        x = f"replace({x}, '{emoji}', ' {words} ')"
    x = _links(x)
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|[^{W}])#([{W}]+)', '\\1\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '(?i)(^|[^{W}])rt($|[^{W}])', '\\1 \\2', 'g')"
    x = f"translate(lower({x}), {quoted(fixed.MODEL_LEET_FROM)}, {quoted(fixed.MODEL_LEET_TO)})"
    return _squeezed(_runs(x, 2))


def _re2(pattern: str) -> str:
    """Escapes of four digits as RE2 writes them."""
    import re

    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)


def document_sql(x: str) -> str:
    x = _links(f"coalesce({x}, '')")
    mark = f"[^{W}{BLANK}]"
    x = f"regexp_replace({x}, '{mark}{{2,}}', ' ', 'g')"  # of several marks each stands at an edge
    x = f"regexp_replace({x}, '(^|[{BLANK}]){mark}', '\\1 ', 'g')"
    x = f"regexp_replace({x}, '{mark}([{BLANK}]|$)', ' \\1', 'g')"
    x = f"regexp_replace(lower({model_sql(x)}), '[^0-9a-zçğıöşü{BLANK}]', ' ', 'g')"
    stop = ", ".join(quoted(w) for w in fixed.STOPWORDS)
    return f"array_to_string(list_filter(string_split_regex({x}, '[{BLANK}]+'), lambda t: t <> '' AND t NOT IN ({stop})), ' ')"


# --- rules over the test lexicon, as SQL of a text expression ---
_TERMS = "[" + ", ".join(quoted(t) for t in TEST_LEXICON.terms) + "]"
_HARD = "[" + ", ".join(quoted(t) for t in TEST_LEXICON.hard) + "]"


def _plain(x: str) -> str:
    return f"translate({x}, '{fixed.PLAIN_FROM}', '{fixed.PLAIN_TO}')"


def rule_sql(x: str) -> dict[str, str]:
    edge, end = f"(^|[^{W}])", f"($|[^{W}])"
    spaced = "|".join(r"[^\p{L}\p{N}]+".join(t) for t in TEST_LEXICON.terms if len(t) >= 3)
    once = _runs(f"lower({x})", 1)
    return {
        "hard_term": f"len(list_intersect(string_split_regex(translate({_plain(f'lower({x})')}, {quoted(rules.PUNCTUATION)}, '{' ' * len(rules.PUNCTUATION)}'), '[{BLANK}]+'), {_HARD})) > 0",
        "spaced": f"regexp_matches({_plain(f'lower({x})')}, '{edge}({spaced}){end}')",
        "leet": f"(regexp_matches({x}, '[@4\\^83€69#1!|05$§7+]') AND len(list_intersect(regexp_extract_all(translate({_plain(f'lower({x})')}, '{fixed.RULE_LEET_FROM}', '{fixed.RULE_LEET_TO}'), '[a-zçğıöşü]+'), {_TERMS})) > 0)",
        "repeated": f"(length({once}) < length({x}) AND len(list_intersect(regexp_extract_all({_plain(once)}, '[a-zçğıöşü]+'), {_TERMS})) > 0)",
        "phrase": f"regexp_matches(lower({x}), '{edge}of[{BLANK}]+the{end}|{edge}de[{BLANK}]+la{end}|der[{BLANK}]*die')",
    }


QUERIES: dict[str, tuple[Query, str | None]] = {}

QUERIES["normalize_model"] = (
    lambda s, d: spread(read(s, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(text.for_model(F.col("text")), 256).alias("h")),
    f"SELECT doc_id, sha256({model_sql('text')}) AS h FROM documents",
)
QUERIES["normalize_document"] = (
    lambda s, d: spread(read(s, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(text.for_document(F.col("text")), 256).alias("h")),
    f"SELECT doc_id, sha256({document_sql('text')}) AS h FROM documents",
)
QUERIES["stopword_filter"] = (
    lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(text.without_words(F.lower("text"), ("the", "of", "de", "la")), 256).alias("h")),
    f"SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(lower(text), '[{BLANK}]+'), lambda t: t <> '' AND t NOT IN ('the', 'of', 'de', 'la')), ' ')) AS h FROM documents",
)
#: Texts that the compatibility form changes, and one that it does not.
_FORMS = ("ﬁne", "①②③", "ｆｕｌｌ ｗｉｄｔｈ", "x²", "e\u0301a\u0308", "㎏", "Å", "plain")
QUERIES["nfkc"] = (
    lambda s, d: read(s, d, "documents").select("doc_id", text.nfkc(F.concat(F.element_at(F.array(*[F.lit(x) for x in _FORMS]), (F.pmod("doc_id", F.lit(len(_FORMS))) + 1).cast("int")), F.substring("text", 1, 40))).alias("form")),
    "SELECT doc_id, list_extract([" + ", ".join(quoted(unicodedata.normalize("NFKC", x)) for x in _FORMS) + f"], CAST(doc_id % {len(_FORMS)} + 1 AS BIGINT)) || substr(text, 1, 40) AS form FROM documents",
)
QUERIES["emoji_words"] = (
    lambda s, d: messages(s, d).select("user_id", "seq", F.sha2(rules.emojis_as_words(F.concat(F.substring("text", 1, 20), F.element_at(F.array(*[F.lit(x) for x in fixed.EMOJIS]), (F.pmod("seq", F.lit(12)) + 1).cast("int")))), 256).alias("h")),
    f"WITH {M} SELECT user_id, seq, sha256(substr(text, 1, 20) || list_extract([" + ", ".join(quoted(f" {w} ") for w in fixed.EMOJIS.values()) + "], CAST(seq % 12 + 1 AS BIGINT))) AS h FROM msg",
)
_ODD = {"ça\u200bva": "cava", "ı\u0307x": "ıx", "ﬀ\u00adé": "ffe", "ж\ufeffй": "жи", "plain": "plain"}
QUERIES["plain_unicode"] = (
    lambda s, d: read(s, d, "labels").select("doc_id", rules.plain_unicode(F.element_at(F.array(*[F.lit(x) for x in _ODD]), (F.pmod("doc_id", F.lit(len(_ODD))) + 1).cast("int"))).alias("plain")),
    "SELECT doc_id, list_extract([" + ", ".join(quoted(x) for x in _ODD.values()) + f"], CAST(doc_id % {len(_ODD)} + 1 AS BIGINT)) AS plain FROM labels",
)
_SWAPS = rules.Lexicon(terms=("reble", "thing", "ering", "onble"), contextual=(), phrases=())
QUERIES["letter_swaps"] = (
    lambda s, d: tables.word_rows(labelled(s, d)).groupBy("word").agg(F.count("*").alias("n")).select("word", "n", rules.unswapped(F.col("word"), _SWAPS).alias("term")).filter("term <> word"),
    f"WITH {L}, w AS (SELECT unnest(string_split_regex(text, '[{BLANK}]+')) AS word FROM lab), sw(form, term) AS (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in rules.swapped_forms(_SWAPS).items())
    + f") SELECT word, count(*) AS n, any_value(term) AS term FROM w JOIN sw ON {_plain('lower(word)')} = form WHERE term <> word GROUP BY word",
)
QUERIES["fuzzy_terms"] = (
    lambda s, d: tables.word_rows(spread(labelled(s, d).select("satir_no", "text"), "satir_no")).select(F.lower("word").alias("word")).distinct().select("word", rules.nearest_term(TEST_LEXICON)(F.col("word")).alias("f")).select("word", "f.term", F.col("f.score").alias("score")).filter("score IS NOT NULL"),
    None,
)

def _fuzzy_sides(s, d):
    """All words of the labelled texts, and the words of the toxic ones as terms."""
    lab = labelled(s, d)
    words, terms = (tables.word_rows(x).select(F.lower("word").alias("word")).distinct() for x in (lab, lab.filter("label = 1")))
    return words, terms.filter("length(word) >= 4").select(F.col("word").alias("term"), F.col("word").alias("rank"))


def _fuzzy_candidates(s, d):
    words, terms = _fuzzy_sides(s, d)
    plain = [x.select(text.plain_letters(F.col(x.columns[0])).alias("form")) for x in (words.filter("length(word) >= 4"), terms)]
    return fuzzy.candidates(*plain)


def _key_sql(side: str) -> str:
    """The keys of fuzzy.candidates as a DuckDB list over form, a, b and m."""
    one = "list_transform(range(1, length({x}) + 1), lambda {i}: substr({x}, 1, {i} - 1) || substr({x}, {i} + 1))"
    once = one.format(x="form", i="i")
    twice = f"flatten(list_transform({once}, lambda y: {one.format(x='y', i='j')}))"
    size = "(b * (i + 1) // (a + b - 2 * m + 1) - b * i // (a + b - 2 * m + 1))"
    start = "b * i // (a + b - 2 * m + 1)"
    pieces = f"list_transform(range(0, a + b - 2 * m + 1), lambda i: i || ':' || substr(form, {start} + 1, {size}))"
    moved = f"list_transform(list_filter(list_transform(range(m - b, a - m + 1), lambda k: {start} + k), lambda p: p >= 0 AND p + {size} <= a), lambda p: i || ':' || substr(form, p + 1, {size}))"
    long = pieces if side == "b" else f"flatten(list_transform(range(0, a + b - 2 * m + 1), lambda i: {moved}))"
    return f"CASE WHEN greatest(a, b) - m > {fuzzy.DEPTH} THEN {long} WHEN {side} - m = 0 THEN [form] WHEN {side} - m = 1 THEN {once} ELSE {twice} END"


def _sided_sql(name: str, rows: str, own: str, other: str) -> str:
    return (
        f"{name}n AS (SELECT form, CAST(length(form) AS BIGINT) AS {own}, unnest(range(length(form) - 2, length(form) + 3)) AS {other} FROM {rows} WHERE form <> ''), "
        f"{name}m AS (SELECT *, (179 * (a + b) + 399) // 400 AS m FROM {name}n WHERE {other} > 0), "
        f"{name}k AS (SELECT DISTINCT form, a, b, unnest({_key_sql(own)}) AS key FROM {name}m WHERE m <= least(a, b))"
    )


QUERIES["fuzzy_candidates"] = (
    _fuzzy_candidates,
    f"WITH {L}, x AS (SELECT DISTINCT label, lower(word) AS word FROM (SELECT label, unnest(string_split_regex(text, '[{BLANK}]+')) AS word FROM lab) WHERE length(lower(word)) >= 4), "
    f"fw AS (SELECT DISTINCT {_plain('word')} AS form FROM x), ft AS (SELECT DISTINCT {_plain('word')} AS form FROM x WHERE label = 1), "
    f"{_sided_sql('w', 'fw', 'a', 'b')}, {_sided_sql('t', 'ft', 'b', 'a')} SELECT DISTINCT wk.form AS word, tk.form AS term FROM wk JOIN tk USING (a, b, key)",
)
QUERIES["fuzzy_nearest"] = (lambda s, d: fuzzy.nearest(*_fuzzy_sides(s, d)), None)
QUERIES["stem_words"] = (
    lambda s, d: tables.word_rows(messages(s, d)).select(rules.stem(F.col("word")).alias("word")).groupBy("word").agg(F.count("*").alias("n")),
    f"WITH {M} SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[{BLANK}]+')) AS word FROM msg) WHERE word <> '' GROUP BY word",
)
QUERIES["repetition_hits"] = (
    lambda s, d: messages(s, d).select("user_id", "seq", rules.repeated(F.col("text"), TEST_LEXICON).alias("hit")),
    f"WITH {M} SELECT user_id, seq, {rule_sql('text')['repeated']} AS hit FROM msg",
)
_RAW, _NORM = rule_sql("text"), rule_sql("norm")
_FULL = f"{M}, nm AS (SELECT *, {model_sql('text')} AS norm FROM msg), hits AS (SELECT *, {' OR '.join([*_RAW.values(), *_NORM.values()])} AS hit, CASE " + " ".join(f"WHEN {sql} THEN '{name}'" for name, sql in _RAW.items()) + " END AS rule FROM nm)"
QUERIES["dictionary_check"] = (
    lambda s, d: messages(s, d).select("user_id", "seq", rules.full_hit(F.col("text"), TEST_LEXICON).alias("hit"), rules.first_rule(F.col("text"), TEST_LEXICON).alias("rule")),
    f"WITH {_FULL} SELECT user_id, seq, hit, rule FROM hits",
)
QUERIES["dictionary_sets"] = (
    lambda s, d: read(s, d, "documents").select("doc_id", lexicon_sets.first_rule(F.col("text"), TEST_LEXICON).alias("rule")),
    "SELECT doc_id, CASE " + " ".join(f"WHEN {sql} THEN '{name}'" for name, sql in rule_sql("coalesce(text, '')").items()) + " END AS rule FROM documents",
)
_KEY = "k"
_INNER, _OUTER = (bytes(b ^ pad for b in _KEY.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
_HMAC = f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(text))))"
QUERIES["content_hmac"] = (
    lambda s, d: read(s, d, "documents").select("doc_id", text.hmac_sha256(F.col("text"), _KEY.encode()).alias("h")),
    f"SELECT doc_id, {_HMAC} AS h FROM documents",
)


def _log(s, d):
    buffered = messages(s, d).withColumns({
        "created_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("user_id") * 60 + F.col("seq")),
        "buffer_hit": F.col("user_id") % 17 == 0,
        "score": F.when(F.col("user_id") % 3 != 0, F.pmod(F.col("user_id") * 37 + F.col("seq") * 101, F.lit(1000)) / 1000),
    })
    few = rules.Lexicon(terms=("idiot", "loser", "moron", "scum", "ionion"), contextual=(), phrases=(r"der\s*die",))
    log = moderation.log_rows(buffered, few, threshold=0.8, key=_KEY, model_version="v1", retention_days=30)
    opened = service.decrypted(F.col("encrypted_text"), _KEY)
    return log.select("user_id", "seq", "displayed_text", "is_toxic", F.round("toxicity_score", 4).alias("toxicity_score"), "category", "severity", "detection_method", "action_taken", "review_status", "content_hash", F.sha2(opened, 256).alias("opened"), F.unix_seconds("expires_at").alias("expires"))


def _log_sql() -> str:
    terms = ("idiot", "loser", "moron", "scum", "ionion")
    few = "[" + ", ".join(quoted(t) for t in terms) + "]"
    edge, end = f"(^|[^{W}])", f"($|[^{W}])"
    spaced = "|".join(r"[^\p{L}\p{N}]+".join(t) for t in terms)

    def hit(x: str) -> str:
        once = _runs(f"lower({x})", 1)
        parts = [
            rule_sql(x)["hard_term"].replace(_HARD, few), f"regexp_matches({_plain(f'lower({x})')}, '{edge}({spaced}){end}')",
            rule_sql(x)["leet"].replace(_TERMS, few), f"(length({once}) < length({x}) AND len(list_intersect(regexp_extract_all({_plain(once)}, '[a-zçğıöşü]+'), {few})) > 0)",
            f"regexp_matches(lower({x}), 'der[{BLANK}]*die')",
        ]
        return " OR ".join(parts)

    threat = " OR ".join(f"contains(lower(text), '{t}')" for t in fixed.THREATS)
    return (
        f"WITH {M}, nm AS (SELECT *, {model_sql('text')} AS norm FROM msg), "
        f"x AS (SELECT *, ({hit('text')} OR {hit('norm')}) AS r, user_id % 17 = 0 AS b, CASE WHEN user_id % 3 <> 0 THEN CAST((user_id * 37 + seq * 101) % 1000 AS DOUBLE) / 1000 END AS q FROM nm), "
        "y AS (SELECT *, CASE WHEN r OR b THEN 'toxic' WHEN q IS NULL THEN 'clean' WHEN q >= 0.8 THEN 'toxic' WHEN q >= 0.8::DOUBLE - 0.1::DOUBLE THEN 'review' ELSE 'clean' END AS st, "
        "CASE WHEN r THEN 'dictionary_evasion' WHEN b THEN 'message_buffer' WHEN q IS NULL THEN 'rules_only_clean' ELSE 'bert_calibrated' END AS detection_method FROM x), "
        f"z AS (SELECT *, CASE WHEN st = 'clean' THEN 'clean' WHEN {threat} THEN 'threat' WHEN detection_method IN ('dictionary_evasion', 'message_buffer') THEN 'targeted_abuse' ELSE 'offensive_language' END AS category FROM y) "
        f"SELECT user_id, seq, CASE st WHEN 'toxic' THEN '{moderation.HIDDEN}' WHEN 'review' THEN '{moderation.WAITING}' ELSE text END AS displayed_text, st = 'toxic' AS is_toxic, "
        "round(CAST(CASE WHEN r THEN 0.99 WHEN b THEN 0.95 WHEN q IS NULL THEN 0 ELSE q END AS DOUBLE), 4) AS toxicity_score, category, "
        "CASE category WHEN 'threat' THEN 'critical' WHEN 'targeted_abuse' THEN 'high' WHEN 'clean' THEN 'none' ELSE 'medium' END AS severity, detection_method, "
        "CASE st WHEN 'toxic' THEN 'warned' WHEN 'review' THEN 'queued_for_review' ELSE 'passed' END AS action_taken, CASE WHEN st = 'review' THEN 'pending' ELSE 'not_required' END AS review_status, "
        f"{_HMAC} AS content_hash, sha256(text) AS opened, CAST(1700000000 + user_id * 60 + seq + 30 * 86400 AS BIGINT) AS expires FROM z"
    )


QUERIES["message_log"] = (_log, _log_sql())
QUERIES["entity_keys"] = (
    lambda s, d: read(s, d, "documents").select("doc_id", csv.entity_key(F.when(F.col("doc_id") % 4 != 0, F.col("source")), "src", False).alias("plain"), csv.entity_key(F.substring("text", 1, 60), "src", True).alias("textual")),
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR trim(source) = '' THEN '' ELSE 'src:' || substr(sha256(lower(upper(trim(source)))), 1, 16) END AS plain, "
    f"CASE WHEN trim(substr(text, 1, 60)) = '' THEN '' ELSE 'src:' || substr(sha256({document_sql('trim(substr(text, 1, 60))')}), 1, 16) END AS textual FROM documents",
)
