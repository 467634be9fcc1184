"""The rules of `rules` for lexicons of many terms, as hash sets.

A regex of ten thousand alternatives tries each at every place.  Here a text is cut into words
once and each word is looked up in a set of literals (which Spark keeps as InSet, inside its
generated code), so a look-up does not grow with the lexicon; building the plan does, by one literal a
term and rule.  Spaced terms: letters that stand alone
are joined to runs, every stretch of a run that is as long as some term is looked up, and only terms
found so are held against their own pattern.  Results are those of `rules`.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, rules
from .rules import PUNCTUATION, Lexicon, _plain
from .text import BLANK, WORD, plain_letters

_GAP = r"[^\p{L}\p{N}]+"


def _any_of(words: Column, terms) -> Column:
    known = sorted(set(terms))
    return F.exists(words, lambda w: w.isin(known)) if known else F.lit(False)


def hard_term(c: Column, lexicon: Lexicon) -> Column:
    words = F.split(F.translate(plain_letters(F.lower(c)), PUNCTUATION, " " * len(PUNCTUATION)), f"[{BLANK}]+")
    return _any_of(words, (_plain(t) for t in lexicon.hard))


def spaced(c: Column, lexicon: Lexicon) -> Column:
    low = plain_letters(F.lower(c))
    long = {_plain(t) for t in lexicon.terms if len(t) >= 3}
    lettered = sorted(t for t in long if all(x.isalnum() for x in t))
    odd = tuple(sorted(long - set(lettered)))  # terms with blanks or signs are no runs of letters
    parts = []
    if lettered:
        alone = F.concat_ws("", F.transform(F.split(low, _GAP), lambda w: F.when(F.length(w) == 1, w).otherwise(F.lit(" "))))
        sizes = sorted({len(t) for t in lettered})
        runs = F.filter(F.split(alone, " +"), lambda r: F.length(r) >= sizes[0])

        def sized(run: Column, n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1)))
            return F.transform(starts, lambda i: run.substr(i, F.lit(n)))

        def stretches(run: Column) -> Column:
            return F.flatten(F.array(*[sized(run, n) for n in sizes]))

        found = F.filter(F.array_distinct(F.flatten(F.transform(runs, stretches))), lambda s: s.isin(lettered))
        edges = (F.lit(f"(?<![{WORD}])"), F.lit(f"(?![{WORD}])"))
        parts.append(F.exists(found, lambda t: F.regexp_like(low, F.concat(edges[0], F.array_join(F.split(t, ""), _GAP), edges[1]))))
    if odd:
        parts.append(rules.spaced(c, Lexicon(terms=odd, contextual=(), phrases=())))
    return reduce(or_, parts) if parts else F.lit(False)


def leet(c: Column, lexicon: Lexicon) -> Column:
    decoded = F.translate(plain_letters(F.lower(c)), fixed.RULE_LEET_FROM, fixed.RULE_LEET_TO)
    words = F.regexp_extract_all(decoded, F.lit("([a-zçğıöşü]+)"), 1)
    return c.rlike(fixed.RULE_LEET_MARK.replace("^", r"\^")) & _any_of(words, map(_plain, lexicon.terms))


def repeated(c: Column, lexicon: Lexicon) -> Column:
    low = F.lower(c)
    once = plain_letters(F.regexp_replace(low, r"([^\n])\1+", "$1"))
    words = F.regexp_extract_all(once, F.lit("([a-zçğıöşü]+)"), 1)
    return low.rlike(r"([^\n])\1") & _any_of(words, map(_plain, lexicon.terms))


def first_rule(c: Column, lexicon: Lexicon) -> Column:
    """Name of the first rule that hits, or null; null texts are no hits."""
    c = F.coalesce(c, F.lit(""))
    named = {"hard_term": hard_term, "spaced": spaced, "leet": leet, "repeated": repeated}
    if lexicon.phrases:
        named["phrase"] = rules.phrase
    return F.coalesce(*[F.when(rule(c, lexicon), name) for name, rule in named.items()])
