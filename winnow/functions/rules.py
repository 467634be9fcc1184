"""Moderation rules as boolean columns over a configurable lexicon."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .text import BLANK, WORD, for_model, plain_letters, unicode_pattern

_HIDDEN = re.compile(fixed.INVISIBLE_SPACES)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain(word: str) -> str:
    return word.translate(str.maketrans(fixed.PLAIN_FROM, fixed.PLAIN_TO))


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[str, ...] = fixed.LEXICON
    contextual: tuple[str, ...] = fixed.CONTEXTUAL
    phrases: tuple[str, ...] = fixed.PHRASES

    @property
    def hard(self) -> tuple[str, ...]:
        return tuple(t for t in self.terms if t not in self.contextual)


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def hard_term(c: Column, lexicon: Lexicon = Lexicon()) -> Column:
    words = F.split(F.translate(plain_letters(F.lower(c)), PUNCTUATION, " " * len(PUNCTUATION)), f"[{BLANK}]+")
    return F.arrays_overlap(words, _literals(_plain(t) for t in lexicon.hard))


def spaced(c: Column, lexicon: Lexicon = Lexicon()) -> Column:
    gap = r"[^\p{L}\p{N}]+"
    words = "|".join(gap.join(map(re.escape, _plain(t))) for t in lexicon.terms if len(t) >= 3)
    return plain_letters(F.lower(c)).rlike(f"(?<![{WORD}])(?:{words})(?![{WORD}])")


def leet(c: Column, lexicon: Lexicon = Lexicon()) -> Column:
    decoded = F.translate(plain_letters(F.lower(c)), fixed.RULE_LEET_FROM, fixed.RULE_LEET_TO)
    words = F.regexp_extract_all(decoded, F.lit("([a-zçğıöşü]+)"), 1)
    return c.rlike(fixed.RULE_LEET_MARK.replace("^", r"\^")) & F.arrays_overlap(words, _literals(_plain(t) for t in lexicon.terms))


def repeated(c: Column, lexicon: Lexicon = Lexicon()) -> Column:
    low = F.lower(c)
    once = plain_letters(F.regexp_replace(low, r"([^\n])\1+", "$1"))
    words = F.regexp_extract_all(once, F.lit("([a-zçğıöşü]+)"), 1)
    return low.rlike(r"([^\n])\1") & F.arrays_overlap(words, _literals(_plain(t) for t in lexicon.terms))


def phrase(c: Column, lexicon: Lexicon = Lexicon()) -> Column:
    return F.lower(c).rlike("|".join(unicode_pattern(p) for p in lexicon.phrases))


def dictionary_hit(c: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Any rule; null texts are no hits."""
    c = F.coalesce(c, F.lit(""))
    return hard_term(c, lexicon) | spaced(c, lexicon) | leet(c, lexicon) | repeated(c, lexicon) | phrase(c, lexicon)


def first_rule(c: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Name of the first rule that hits, or null."""
    return (
        F.when(hard_term(c, lexicon), "hard_term").when(spaced(c, lexicon), "spaced").when(leet(c, lexicon), "leet")
        .when(repeated(c, lexicon), "repeated").when(phrase(c, lexicon), "phrase")
    )


def full_hit(c: Column, lexicon: Lexicon = Lexicon(), unicode_form: bool = True) -> Column:
    return dictionary_hit(c, lexicon) | dictionary_hit(for_model(c, unicode_form), lexicon)


def category(c: Column, method: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    threat = F.lit(False)
    for t in fixed.THREATS:
        threat = threat | low.contains(t)
    return F.when(threat, "threat").when(method.isin("dictionary_evasion", "message_buffer"), "targeted_abuse").otherwise("offensive_language")


def severity(category_: Column) -> Column:
    return F.when(category_ == "threat", "critical").when(category_ == "targeted_abuse", "high").when(category_ == "clean", "none").otherwise("medium")


def decide(rule_hit: Column, buffer_hit: Column, score: Column, threshold: float) -> dict[str, Column]:
    """status, score and method from rules and an optional model score (null: rules only)."""
    low = max(0.5, threshold - 0.1)
    status = (
        F.when(rule_hit | buffer_hit, "toxic").when(score.isNull(), "clean").when(score >= threshold, "toxic")
        .when(score >= low, "review").otherwise("clean")
    )
    value = F.when(rule_hit, 0.99).when(buffer_hit, 0.95).when(score.isNull(), 0.0).otherwise(F.bround(score, 4))
    method = (
        F.when(rule_hit, "dictionary_evasion").when(buffer_hit, "message_buffer").when(score.isNull(), "rules_only_clean").otherwise("bert_calibrated")
    )
    return {"status": status, "score": value, "method": method}


# --- opt-in functions: no rule above calls them ---


@F.pandas_udf(T.StringType())
def plain_unicode(texts: pd.Series) -> pd.Series:
    """Texts without invisible characters and marks; letters of other alphabets stay, accents go."""

    def plain(text: str) -> str:
        whole = unicodedata.normalize("NFKD", _HIDDEN.sub("", text))
        return "".join(c for c in whole if c.isascii() or not unicodedata.category(c).startswith("M"))

    return texts.map(plain, na_action="ignore")


def emojis_as_words(c: Column) -> Column:
    for emoji, words in fixed.EMOJIS.items():
        c = F.replace(c, F.lit(emoji), F.lit(f" {words} "))
    return c


def swapped_forms(lexicon: Lexicon = Lexicon(), least: int = 5) -> dict[str, str]:
    """Each plain term of at least `least` letters with two neighbours exchanged, and the first term it comes from."""
    out: dict[str, str] = {}
    plain = {t: _plain(t.lower()) for t in lexicon.terms}
    for term, word in plain.items():
        for k in range(len(word) - 1 if len(word) >= least else 0):
            if word[k] != word[k + 1]:
                out.setdefault(word[:k] + word[k + 1] + word[k] + word[k + 2 :], term)
    return out


def unswapped(word: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """The term of which a word is one exchange of neighbours away, else the word."""
    pairs = swapped_forms(lexicon)
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(table, plain_letters(F.lower(word))), word)


def stem(word: Column) -> Column:
    """The word itself: cutting endings makes harmless words look like terms."""
    return word


def nearest_term(lexicon: Lexicon = Lexicon(), least: int = 4, apart: int = 2, score: int = 90):
    """A function of a word: struct of the most similar term and its similarity in hundredths, nulls if below score.

    Words shorter than least are not compared, nor terms that differ by more than apart in length;
    of equals the first term counts.
    """
    plain = [(t, _plain(t.lower())) for t in lexicon.terms]

    def best(word: str | None) -> tuple[str | None, int | None]:
        if word is None or len(word) < least:
            return None, None
        own, found = _plain(word.lower()), (None, max(score, 1) - 1)
        for term, form in plain:
            both = len(own) + len(form)
            # the ratio is at most what lengths and then common characters allow; most pairs end there
            if abs(len(own) - len(form)) <= apart and both and round(200 * min(len(own), len(form)) / both) > found[1]:
                matcher = SequenceMatcher(None, own, form)
                if round(100 * matcher.quick_ratio()) > found[1] and (ratio := round(100 * matcher.ratio())) > found[1]:
                    found = (term, ratio)
        return found if found[0] is not None else (None, None)

    @F.pandas_udf("term string, score int")
    def run(words: pd.Series) -> pd.DataFrame:
        known = {w: best(w) for w in words.dropna().unique()}
        return pd.DataFrame([known.get(w, (None, None)) for w in words], columns=["term", "score"]).astype({"score": "Int32"})

    return run
