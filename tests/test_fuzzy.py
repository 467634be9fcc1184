import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from winnow.functions import rules
from winnow.operators import fuzzy


def _mutated(rng, word, edits):
    w = list(word)
    for _ in range(edits):
        k = rng.randrange(len(w) + 1)
        if rng.random() < 0.5 and len(w) > 3:
            del w[k - 1]
        else:
            w.insert(k, rng.choice("abcş"))
    return "".join(w)


def _vocabulary(seed):
    rng = random.Random(seed)
    terms = ["".join(rng.choice("abcdeçğ") for _ in range(rng.choice([1, 3, 4, 5, 8, 9, 10, 14, 19, 20, 25, 33, 60]))) for _ in range(60)]
    words = [_mutated(rng, rng.choice(terms), rng.randrange(9)) for _ in range(500)] + terms + ["", "abc", "A" * 5000, "ÇĞabcde"]
    return words, terms + [terms[0], ""]


@pytest.mark.parametrize("score", [90, 85, 76])
def test_nearest_equals_plain_loop(spark, score):
    words, terms = _vocabulary(score)
    want = {}
    for word in set(words):
        own, best = rules._plain(word.lower()), (None, 0)
        for term in terms if len(word) >= 4 else []:
            form = rules._plain(term.lower())
            if own and form and abs(len(own) - len(form)) <= 2:
                ratio = round(100 * SequenceMatcher(None, own, form).ratio())
                if ratio > best[1]:
                    best = (term, ratio)
        if best[1] >= score:
            want[word] = best
    w = spark.createDataFrame([(x,) for x in [*words, *words[:50], None]], "word string")
    t = spark.createDataFrame([*enumerate(terms), (99, None)], "rank int, term string")
    got = {r["word"]: (r["term"], r["score"]) for r in fuzzy.nearest(w, t, score=score).collect()}
    assert got == want and len(want) > 150 and any(x[1] < 100 for x in want.values())


def test_keys_miss_no_pair_and_stay_joins(spark):
    words, terms = _vocabulary(4)
    w, t = (spark.createDataFrame([(x,) for x in xs], "form string") for xs in (words, terms))
    pairs = fuzzy.candidates(w, t)
    got = {(r["word"], r["term"]) for r in pairs.collect()}
    for u in set(words) - {""}:
        for v in set(terms) - {""}:
            if abs(len(u) - len(v)) <= 2 and round(100 * SequenceMatcher(None, u, v).ratio()) >= 90:
                assert (u, v) in got
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_equal_to_column_function_and_edges(spark):
    lexicon = rules.Lexicon(terms=("salak", "abdullah", "abdulah", "gerizekali"), contextual=(), phrases=())
    w = spark.createDataFrame([("abdulllah",), ("gerizekalı",), ("gerzekali",), ("sala",), (None,)], "word string")
    t = spark.createDataFrame(list(enumerate(lexicon.terms)), "rank int, term string")
    got = {r["word"]: (r["term"], r["score"]) for r in fuzzy.nearest(w, t).collect()}
    plain = w.select("word", rules.nearest_term(lexicon)(F.col("word")).alias("f")).filter("f.score IS NOT NULL").collect()
    assert got == {r["word"]: (r["f"]["term"], r["f"]["score"]) for r in plain} and got
    assert fuzzy.nearest(w.limit(0), t).count() == 0 and fuzzy.nearest(w, t.limit(0)).count() == 0
    with pytest.raises(ValueError, match="score"):
        fuzzy.candidates(w, t, score=50)
