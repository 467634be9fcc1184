import random

from pyspark.sql import functions as F

from winnow.functions import lexicon_sets, rules


def _lexicon(rng, n):
    terms = {"".join(rng.choice("abcdeçşkı") for _ in range(rng.choice([2, 3, 4, 5, 6]))) for _ in range(n)}
    return rules.Lexicon(terms=(*sorted(terms), "a-b", "iki söz"), contextual=tuple(sorted(terms)[::7]), phrases=(r"\bab\s+cd\b",))


def _texts(rng, terms, n):
    shapes = [
        lambda t: t, str.upper, lambda t: " ".join(t), lambda t: ".".join(t), lambda t: "_".join(t), lambda t: f"x{'-'.join(t)}", lambda t: f"_ {' '.join(t)} z",
        lambda t: f"{' '.join(t)}_", lambda t: "".join(x * rng.randrange(1, 3) for x in t), lambda t: t.replace("a", "4").replace("e", "3"), lambda t: f"q w {' * '.join(t)} r", lambda t: f"zz{t}",
    ]
    made = [" ".join(rng.choice(["söz", "1", "zzz", "!", "ab  cd", "n"]) if rng.random() < 0.5 else rng.choice(shapes)(rng.choice(terms)) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    return [*made, "", None, "a " * 3000, "x" * 20_000, "a - b", "a - - - b"]


def test_same_rules_as_regexes(spark):
    rng = random.Random(2)
    lexicon = _lexicon(rng, 40)
    df = spark.createDataFrame([(t,) for t in _texts(rng, lexicon.terms, 1500)], "t string")
    c = F.coalesce("t", F.lit(""))
    for name in ("hard_term", "spaced", "leet", "repeated"):
        pairs = df.select("t", getattr(lexicon_sets, name)(c, lexicon).alias("a"), getattr(rules, name)(c, lexicon).alias("b")).collect()
        assert [r for r in pairs if r["a"] != r["b"]] == [] and 0 < sum(r["a"] for r in pairs) < len(pairs), name
    both = df.select(lexicon_sets.first_rule(F.col("t"), lexicon).alias("a"), rules.first_rule(c, lexicon).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and {r["a"] for r in both} == {None, "hard_term", "spaced", "leet", "repeated", "phrase"}


def test_large_lexicon_is_a_hash_set(spark):
    lexicon = rules.Lexicon(terms=tuple(f"t{k:x}z".translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(3000)), contextual=(), phrases=())
    df = spark.createDataFrame([(" ".join(lexicon.terms[77]),), (lexicon.terms[5],), ("none",)], "t string").select(lexicon_sets.first_rule(F.col("t"), lexicon).alias("r"))
    assert [r["r"] for r in df.collect()] == ["spaced", "hard_term", None]
    assert " INSET " in df._jdf.queryExecution().optimizedPlan().toString()
