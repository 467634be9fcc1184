"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

One pattern finds candidates; each is validated for its kind and permuted by a keyed Feistel
network within its own format, so that equal values get equal pseudonyms in all documents and
different values get different ones.  Kinds:

* card: 13 to 19 digits that pass the Luhn check; all but the last digit are permuted and the
  check digit is computed anew, so that the pseudonym passes too.
* phone: + and a country code with a number of 8 to 15 digits in all, in groups or not, or three,
  three and four digits with separators or the first three in brackets; all digits after the
  country code (its first group, at most three digits) are permuted.
* address: four octets up to 255; 32 bits are permuted.
* date: valid yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy or, if there is no such day, mm/dd/yyyy; days are
  permuted within their 400 years.  A month-first date's pseudonym is month-first and may read as
  that of another, day-first one.
* account: an IBAN of digits, after at most four letters, that passes the check modulo 97; the
  account's digits are permuted and the check digits computed anew.
* mail: the name of at most 64 characters before @ is permuted, letters to letters of their case
  and digits to digits, all marks stay; the domain stays.

What no kind validates stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import carried, read, uncarried

#: A name begins where a run of its characters does, or right after another value; with that, its bound and
#: possessive repeats each character is looked at a fixed number of times, however long a run is.
MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = (
    r"\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}|\+\d{8,15}(?!\d)|\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})[ .-]?\d{2,8}(?:[ .-]\d{2,4}){0,3}(?!\d)"
)
#: Three, three and four digits.
NATIONAL = r"(?<![\d+(.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|[.-]\d)"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z]{4}| ?\d{4})(?: ?\d{4}){1,6}(?: ?\d{1,3})?(?![A-Za-z0-9])"
PATTERN = f"{MAIL}|{ACCOUNT}|{PHONE}|{ADDRESS}|{DATE}|{CARD}|{NATIONAL}"
ROUNDS = 8
KEY_SETTING = "spark.winnow.pii.key"
#: Days of 400 years; 189 * 773 of them.
CYCLE, CYCLE_A, CYCLE_B = 146097, 189, 773


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(a: str, b: str, mod_a: str, mod_b: str, tweak: str, key: str) -> str:
    """SQL for the struct (a, b) after ROUNDS rounds; a in [0, mod_a), b in [0, mod_b)."""

    def noise(x: str) -> str:
        return f"CAST(conv(substr(sha2(concat({_quoted(key)}, {_quoted(tweak)}, i, ':', {x}), 256), 1, 15), 16, 10) AS BIGINT)"

    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT)), (s, i) -> named_struct("
        f"'a', CASE WHEN i % 2 = 1 THEN pmod(s.a + {noise('s.b')}, {mod_a}) ELSE s.a END, "
        f"'b', CASE WHEN i % 2 = 0 THEN pmod(s.b + {noise('s.a')}, {mod_b}) ELSE s.b END))"
    )


def _bind(value: str, name: str, body: str) -> str:
    """SQL for body with name bound once to value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(d: str, tweak: str, key: str) -> str:
    """Permuted digit string of the same length (2 to 30 digits)."""
    low = f"CAST(length({d}) / 2 AS INT)"
    high = f"(length({d}) - {low})"
    state = _feistel(
        f"left({d}, {high})", f"right({d}, {low})", f"CAST(pow(10, {high}) AS BIGINT)", f"CAST(pow(10, {low}) AS BIGINT)", tweak, key
    )
    return _bind(state, "f", f"concat(lpad(CAST(f.a AS STRING), {high}, '0'), lpad(CAST(f.b AS STRING), {low}, '0'))")


def _luhn_sum(d: str, double_last: bool) -> str:
    """Luhn sum of a digit string; double_last: its last digit counts twice."""
    odd = 1 if double_last else 0
    digit = f"CAST(substr({d}, length({d}) - k + 1, 1) AS INT)"
    return (
        f"aggregate(sequence(1, length({d})), 0, (s, k) -> s + CASE WHEN k % 2 = {odd} "
        f"THEN 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END)"
    )


def _laid_out(original: str, digits: str, skip: str = "0") -> str:
    """original with its digits, after the first skip ones, replaced by digits in order."""
    step = (
        f"aggregate(sequence(1, length({original})), named_struct('n', 0, 't', ''), (s, k) -> "
        f"CASE WHEN substr({original}, k, 1) RLIKE '[0-9]' THEN named_struct('n', s.n + 1, 't', concat(s.t, "
        f"CASE WHEN s.n < {skip} THEN substr({original}, k, 1) ELSE substr({digits}, s.n + 1 - {skip}, 1) END)) "
        f"ELSE named_struct('n', s.n, 't', concat(s.t, substr({original}, k, 1))) END)"
    )
    return f"{step}.t"


def _name(x: str, key: str) -> str:
    """Permuted name: a Feistel network whose halves are strings, moved letter by letter."""

    def moved(half: str, other: str) -> str:
        noise = f"sha2(concat({_quoted(key)}, 'mail', i, ':', length({half}), ':', {other}), 512)"
        by = "CAST(conv(substr(n, 4 * pmod(k - 1, 32) + 1, 4), 16, 10) AS INT)"
        c = f"substr({half}, k, 1)"
        each = (
            f"CASE WHEN {c} RLIKE '[0-9]' THEN chr(48 + pmod(ascii({c}) - 48 + {by}, 10)) WHEN {c} RLIKE '[a-z]' THEN chr(97 + pmod(ascii({c}) - 97 + {by}, 26)) "
            f"WHEN {c} RLIKE '[A-Z]' THEN chr(65 + pmod(ascii({c}) - 65 + {by}, 26)) ELSE {c} END"
        )
        return f"CASE WHEN length({half}) = 0 THEN '' ELSE {_bind(noise, 'n', f'array_join(transform(sequence(1, length({half})), k -> {each}), {_quoted('')})')} END"

    low = f"CAST(length({x}) / 2 AS INT)"
    state = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', left({x}, {low}), 'b', substr({x}, {low} + 1)), (s, i) -> named_struct("
        f"'a', CASE WHEN i % 2 = 1 THEN {moved('s.a', 's.b')} ELSE s.a END, 'b', CASE WHEN i % 2 = 0 THEN {moved('s.b', 's.a')} ELSE s.b END))"
    )
    return _bind(state, "f", "concat(f.a, f.b)")


def _mod97(c: str) -> str:
    digit = f"substr({c}, k, 1)"
    return (
        f"aggregate(sequence(1, length({c})), 0, (s, k) -> CASE WHEN {digit} RLIKE '[0-9]' THEN (s * 10 + CAST({digit} AS INT)) % 97 ELSE (s * 100 + ascii({digit}) - 55) % 97 END)"
    )


def _account(x: str, key: str) -> str:
    plain = f"replace({x}, ' ', '')"
    checked = _mod97("concat(substr(c, 5), left(c, 4))")
    own = "regexp_replace(substr(c, 5), '[^0-9]', '')"
    moved = _bind(own, "d", _bind(_digits("d", "account", key), "p", _laid_out("substr(c, 5)", "p")))
    anew = _bind(moved, "q", f"concat(left(c, 2), lpad(CAST(98 - {_mod97("concat(q, left(c, 2), '00')")} AS STRING), 2, '0'), q)")
    spaced = (
        f"aggregate(sequence(1, length({x})), named_struct('n', 0, 't', ''), (s, k) -> CASE WHEN substr({x}, k, 1) = ' ' THEN named_struct('n', s.n, 't', concat(s.t, ' ')) "
        f"ELSE named_struct('n', s.n + 1, 't', concat(s.t, substr(w, s.n + 1, 1))) END).t"
    )
    return _bind(plain, "c", f"CASE WHEN {checked} = 1 THEN {_bind(anew, 'w', spaced)} ELSE {x} END")


def pseudonym_sql(x: str, key: str) -> str:
    """SQL for the pseudonym of candidate x; x itself if no kind validates it."""
    only = "regexp_replace(x, '[^0-9]', '')".replace("x", x)
    card = _bind(only, "d", f"CASE WHEN length(d) BETWEEN 13 AND 19 AND {_luhn_sum('d', False)} % 10 = 0 THEN " + _bind(
        _digits("left(d, length(d) - 1)", "card", key), "p",
        _laid_out(x, f"concat(p, CAST(pmod(-({_luhn_sum('p', True)}), 10) AS STRING))"),
    ) + f" ELSE {x} END")
    country = f"length(regexp_extract({x}, '^[+]([0-9]{{1,3}})', 1))"
    phone = _bind(f"substr({only}, {country} + 1)", "r", f"CASE WHEN length(r) < 5 OR length(r) + {country} NOT BETWEEN 8 AND 15 THEN {x} ELSE " + _bind(
        _digits("r", "phone", key), "p", _laid_out(x, "p", country)
    ) + " END")
    octets = f"transform(split({x}, '[.]'), o -> CAST(o AS BIGINT))"
    address = _bind(octets, "q", f"CASE WHEN array_max(q) > 255 THEN {x} ELSE " + _bind(
        _feistel("q[0] * 256 + q[1]", "q[2] * 256 + q[3]", "65536", "65536", "address", key), "f",
        "concat_ws('.', CAST(f.a DIV 256 AS STRING), CAST(f.a % 256 AS STRING), CAST(f.b DIV 256 AS STRING), CAST(f.b % 256 AS STRING))",
    ) + " END")
    iso = (
        f"CASE WHEN {x} RLIKE '^[0-9]{{4}}-' THEN {x} ELSE concat(substr({x}, 7, 4), '-', substr({x}, 4, 2), '-', left({x}, 2)) END"
    )
    shift = f"datediff(t, DATE'1600-01-01')"
    moved = _feistel(f"pmod({shift}, {CYCLE}) DIV {CYCLE_B}", f"pmod({shift}, {CYCLE}) % {CYCLE_B}", str(CYCLE_A), str(CYCLE_B), "date", key)
    day = _bind(moved, "f", f"date_add(DATE'1600-01-01', CAST({shift} - pmod({shift}, {CYCLE}) + f.a * {CYCLE_B} + f.b AS INT))")
    month_first = f"{x} LIKE '%/%' AND try_cast({iso} AS DATE) IS NULL"
    month_day = f"concat(substr({x}, 7, 4), '-', left({x}, 2), '-', substr({x}, 4, 2))"
    shown = (
        f"CASE WHEN {x} RLIKE '^[0-9]{{4}}-' THEN date_format(p, 'yyyy-MM-dd') WHEN {x} LIKE '%.%' THEN date_format(p, 'dd.MM.yyyy') "
        f"WHEN {month_first} THEN date_format(p, 'MM/dd/yyyy') ELSE date_format(p, 'dd/MM/yyyy') END"
    )
    date = _bind(f"CASE WHEN {month_first} THEN try_cast({month_day} AS DATE) ELSE try_cast({iso} AS DATE) END", "t", f"CASE WHEN t IS NULL THEN {x} ELSE {_bind(day, 'p', shown)} END")
    mail = _bind(f"substring_index({x}, '@', 1)", "m", f"concat({_name('m', key)}, '@', substring_index({x}, '@', -1))")
    return (
        f"CASE WHEN {x} LIKE '%@%' THEN {mail} WHEN {x} RLIKE '^[A-Z]' THEN {_account(x, key)} WHEN {x} LIKE '+%' THEN {phone} "
        f"WHEN {x} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {address} "
        f"WHEN {x} RLIKE '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})$' THEN {date} "
        f"WHEN {x} RLIKE '^([(][0-9]{{3}}[)] ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}$' THEN {phone} "
        f"ELSE {card} END"
    )


def pseudonymise(
    documents: DataFrame, key: str, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Replace personal values of each text by their pseudonyms under key.

    Returns one row per input row: doc_id, n_found (candidates), n_replaced, text, then the
    carried columns.

    * A null text stays null with counts 0; an empty text stays empty.
    * Texts are searched whole, in time that grows with their length, also if they are one unbroken
      word, digit run or dotted run; texts without a digit or @ hold no value and are not searched.
    * Values that no kind validates (a bad check digit, an octet over 255, no such day) stay.
    * Rows are treated alone: repeated rows give equal rows; a null doc_id stays null.
    * An empty table gives an empty result.  Other columns are ignored unless carried.
    """
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), carried(carry).alias("_carry"))
    found = F.when(F.col("_text").rlike("[0-9@]"), F.regexp_extract_all("_text", F.lit(f"({PATTERN})"), 1))
    out = docs.withColumn("_found", found).withColumn("_new", F.expr(f"transform(_found, x -> {pseudonym_sql('x', key)})"))
    parts = F.split("_text", PATTERN, -1)
    pairs = F.arrays_zip(parts.alias("a"), F.concat("_new", F.array(F.lit(""))).alias("b"))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["a"], p["b"])), "")
    changed = F.size(F.filter(F.arrays_zip("_found", "_new"), lambda p: p["_found"] != p["_new"]))
    return out.select(
        F.col("_id").alias(doc_id),
        F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("n_found"),
        F.coalesce(changed, F.lit(0)).cast("long").alias("n_replaced"),
        F.when(F.size("_found") > 0, joined).otherwise(F.col("_text")).alias(text),
        *uncarried(carry),
    ).withColumns({c: F.greatest(c, F.lit(0)) for c in ("n_found", "n_replaced")})


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.winnow.pii.key; without one, a key for demonstrations that hides nothing."""
    return pseudonymise(read(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, "demonstration-key"))
