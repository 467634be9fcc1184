"""Text normalisation as column expressions; NFKC is the one Arrow-batched Python function."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

#: Word characters and white space as Unicode classes; Java's own \w and \s are ASCII.
WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Characters that none of the patterns below begins with, told first: most positions end there.
PLAIN = r"(?![A-Za-z0-9_ ])"
SOLID = r"(?![!-~])"


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility form, a few texts at a time: a batch is held once in each form, not as objects."""
    parts = []
    for start in range(0, len(texts), 64):
        some = texts.slice(start, 64).to_pylist()
        parts.append(pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in some], pa.string()))
    return pa.concat_arrays(parts) if parts else texts.cast(pa.string())


def unicode_pattern(pattern: str) -> str:
    r"""A pattern with \b and \s spelled out for all of Unicode."""
    edge = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
    return pattern.replace(r"\b", edge).replace(r"\s", f"[{BLANK}]")


def squeeze(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SOLID}[{BLANK}]+", " "))


def mark_links(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?=[hHwW])(?i)(?:https?://|www\.)[^{BLANK}]+", " url ")
    return F.regexp_replace(c, rf"@(?<![{WORD}@]@)[{WORD}.]{{2,}}(?![{WORD}@])", " kullanici ")


def for_model(c: Column, unicode_form: bool = True) -> Column:
    """Normal form for models; null gives the empty text.  unicode_form=False leaves NFKC out."""
    return squeeze(_model_form(c, unicode_form))


def _model_form(c: Column, unicode_form: bool) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?![\x00-\x7f]){fixed.INVISIBLE}", "")
    c = nfkc(c) if unicode_form else c
    for emoji, words in fixed.EMOJIS.items():
        c = F.replace(c, F.lit(emoji), F.lit(f" {words} "))
    c = mark_links(c)
    c = F.regexp_replace(c, rf"#(?<![{WORD}]#)([{WORD}]+)", "$1")
    c = F.regexp_replace(c, rf"[rR](?<![{WORD}][rR])[tT](?![{WORD}])", " ")
    c = F.translate(F.lower(c), fixed.MODEL_LEET_FROM, fixed.MODEL_LEET_TO)
    return F.regexp_replace(c, r"([^\n])\1{2,}", "$1$1")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{SOLID}[{BLANK}]+"), lambda x: x != "")


def for_document(c: Column, unicode_form: bool = True, stopwords: tuple[str, ...] = fixed.STOPWORDS) -> Column:
    """Normal form for documents: links, edge punctuation, model form, plain letters, no stop words."""
    c = mark_links(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, rf"{PLAIN}(?:(?<![{WORD}])[^{WORD}{BLANK}]+|[^{WORD}{BLANK}]+(?![{WORD}]))", " ")
    # all that is no letter parts words, white space as well
    words = F.split(F.lower(_model_form(c, unicode_form)), r"(?![0-9a-z])(?iu)[^0-9a-zçğıöşü]+")
    return F.array_join(F.filter(words, lambda x: (x != "") & ~x.isin(*stopwords) if stopwords else x != ""), " ")


def without_words(c: Column, stopwords: tuple[str, ...]) -> Column:
    """The tokens of c that are no stop words, joined by one space."""
    return F.array_join(F.filter(tokens(c), lambda x: ~x.isin(*stopwords)) if stopwords else tokens(c), " ")


def truncated(c: Column, limit: int = 1500) -> Column:
    """Texts over limit characters end before their last space within it."""
    head = F.substring(c, 1, limit)
    return F.when(F.length(c) > limit, F.regexp_replace(head, r" [^ ]*\z", "")).otherwise(c)


def plain_letters(c: Column) -> Column:
    return F.translate(c, fixed.PLAIN_FROM, fixed.PLAIN_TO)


def parse_label(c: Column) -> Column:
    """0, 1 or null from a label's text."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[_-]+", " ")
    number = F.regexp_replace(s, ",", ".")
    plain = F.when(number.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"), F.trim(number).try_cast("double"))
    by_word = F.when(s.isin(*fixed.POSITIVE), 1).when(s.isin(*fixed.NEGATIVE), 0)
    return F.when(plain.isNotNull(), F.when(plain == 1, 1).when(plain == 0, 0)).otherwise(by_word).cast("byte")


def disagrees(agreement: Column) -> Column:
    """Whether a value of an agreement column means that annotators differ; null for null."""
    return F.regexp_replace(F.lower(F.trim(agreement)), "[_-]+", " ").isin(*fixed.DISAGREEMENT)


def reject_reason(text: Column, label: Column, agreement: Column | None = None, min_words: int = 1) -> Column:
    """Why a row is rejected: of several reasons the strongest; null if accepted."""
    disagree = disagrees(agreement) if agreement is not None else F.lit(False)
    return (
        F.when(label.isNull(), "invalid_label")
        .when(F.coalesce(text, F.lit("")) == "", "empty_after_normalization")
        .when(F.coalesce(disagree, F.lit(False)), "annotator_disagreement")
        .when(F.size(tokens(text)) < min_words, "too_short")
    )


def token_number(c: Column) -> Column:
    """A number of a token that no process or seed changes (64-bit, signed)."""
    return F.xxhash64(c)


def hmac_sha256(c: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of c's UTF-8 bytes."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(c, "utf-8")), 256))
    return F.sha2(F.concat(outer, first), 256)
