"""Conflicts, duplicates, groups and splits of labelled texts."""

from __future__ import annotations

import atexit
import hashlib
import json
import math
import re
import tempfile
import uuid
import weakref
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import fixed
from winnow.functions.text import WORD, tokens
from winnow.operators.sequence import close_pairs

#: Folders of the tables that stored wrote, by DataFrame.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

SPLIT_PAIRS = (("train", "valid"), ("train", "test"), ("valid", "test"))


def conflict_texts(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Texts that carry more than one label; null labels do not count."""
    return df.groupBy(text).agg(F.count_distinct(label).alias("n")).filter("n > 1").select(text)


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder.

    A join with it exchanges both sides right before it, so adaptive execution splits a key that
    holds many rows of the other side; an aggregate that is joined as it stands prevents that.
    """
    use_checkpoints(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written compressed to the checkpoint folder and read back; it goes when the driver's interpreter ends."""
    use_checkpoints(df)
    if "void" in df.schema.simpleString():  # a type that files do not have
        return df.checkpoint()
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def removed(*tables: DataFrame) -> None:
    """Remove tables that stored gave and that no later plan reads."""
    for df in tables:
        if path := _STORED.pop(df, None):
            _remove(df.sparkSession, path)


def _remove(spark, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone when the interpreter ends
        pass


def quarantine(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows of texts without a conflict."""
    return df.join(settled(conflict_texts(df, text, label)), text, "left_anti")


def majority(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows whose label more than half of their text's rows carry."""
    pairs = df.groupBy(text, label).agg(F.count("*").alias("_n"))
    won = pairs.groupBy(F.col(text).alias("_t")).agg(F.sum("_n").alias("_all"), F.max_by(label, "_n").alias("_l"), F.max("_n").alias("_most"))
    won = settled(won.filter("2 * _most > _all"))
    return df.join(won, (F.col(text) == F.col("_t")) & (F.col(label) == F.col("_l"))).drop("_t", "_all", "_l", "_most")


def duplicate_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows of texts that occur more than once."""
    return df.join(settled(df.groupBy(text).count().filter("count > 1").select(text)), text, "left_semi")


def first_rows(df: DataFrame, text: str = "text", order: tuple[str, ...] = ("label", "kaynak", "dosya", "satir_no")) -> DataFrame:
    """One row of each text: the first in the given order.  A hot text is aggregated before the exchange."""
    others = [c for c in df.columns if c not in (text, *order)]
    row = F.struct(*[F.col(c) for c in (*order, *others)])
    return df.groupBy(text).agg(F.min(row).alias("_r")).select(text, "_r.*").select(*df.columns)


def group_keys(texts: DataFrame) -> DataFrame:
    """Blocking keys of distinct texts: compact form, whole sequence, bag and single deletions."""
    low = F.lower("text")
    df = texts.select("text", F.regexp_extract_all(low, F.lit(f"([{WORD}çğıöşü]+)"), 1).alias("w")).withColumn("n", F.size("w"))
    compact = F.regexp_replace(low, f"[^{WORD}]", "")
    keys = F.filter(
        F.concat(
            F.array(
                F.when(F.length(compact) >= 4, F.concat(F.lit("c:"), compact)),
                F.when(F.col("n").between(4, 14), F.concat(F.lit("s:"), F.array_join("w", " "))),
                F.when(F.col("n").between(4, 40), F.concat(F.lit("b:"), F.array_join(F.array_sort("w"), " "))),
            ),
            F.when(
                F.col("n").between(5, 14),
                F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("s:"), F.array_join(F.filter("w", lambda x, j: j != i), " "))),
            ).otherwise(F.array().cast("array<string>")),
        ),
        lambda k: k.isNotNull(),
    )
    return df.select("text", "w", F.explode(F.array_distinct(keys)).alias("key"))


def key_hashes(texts: DataFrame) -> DataFrame:
    """(k, n), 64-bit hashes of each key of distinct texts and of its text."""
    return group_keys(texts).select(F.xxhash64("key").alias("k"), F.xxhash64("text").alias("n"))


def keys_among(texts: DataFrame, live: DataFrame) -> DataFrame:
    """group_keys of the texts that live (k, n) names, for its keys alone; texts may repeat."""
    own = texts.select("text").join(live.select("n").distinct(), F.xxhash64("text") == F.col("n"), "left_semi").distinct()
    keyed = group_keys(own).withColumn("k", F.xxhash64("key"))
    return stored(keyed.join(live.select("k").distinct(), "k", "left_semi").select("text", "w", "key"))


def shared_keys(texts: DataFrame) -> DataFrame:
    """group_keys of the keys that several texts hold; texts may repeat.

    All keys travel and are sorted once, as 16 bytes each; texts and words only for keys that are
    shared.  Hashes that meet only leave a key in that one text holds.
    """
    many = F.count("*").over(Window.partitionBy("k"))
    live = stored(key_hashes(texts.select("text").distinct()).withColumn("many", many).filter("many > 1").select("k", "n"))
    return keys_among(texts, live)


def _key_pairs(keyed: DataFrame, threshold: float) -> DataFrame:
    """(key, u, v, sure) of holders (key, text, w): v the first text of the key, u a later one; sure where no ratio is needed."""
    first = settled(keyed.groupBy("key").agg(F.min(F.struct("text", "w")).alias("f"), F.count("*").alias("many")).filter("many > 1"))
    pairs = keyed.join(first, "key").filter("text > f.text").select("key", F.col("text").alias("u"), F.col("f.text").alias("v"), "w", F.col("f.w").alias("fw"))
    shared, union = F.size(F.array_intersect("w", "fw")), F.size(F.array_union("w", "fw"))
    sure = F.col("key").startswith("c:") | F.col("key").startswith("b:") | (union > 0) & (shared / union >= threshold)
    return pairs.select("key", "u", "v", sure.alias("sure"))


def ratio_pairs(keyed: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Distinct pairs (u, v) of a key's later and first text that only the sequence ratio can link by this key."""
    return _key_pairs(keyed, threshold).filter("NOT sure").select("u", "v").distinct()


def key_edges(keyed: DataFrame, threshold: float = 0.9, with_ratio: bool = True) -> DataFrame:
    """(key, u, v) of holders (key, text, w): v the first text of the key and u a later, similar text of it."""
    pairs = _key_pairs(keyed, threshold)
    certain = pairs.filter("sure").select("key", "u", "v").distinct()
    if not with_ratio:
        return certain
    rest = pairs.filter("NOT sure").select("key", "u", "v")
    # a pair is read once, however many keys bring it
    close = close_pairs(rest.select("u", "v").distinct(), threshold)
    return certain.union(rest.join(settled(close), ["u", "v"], "left_semi").select("key", "u", "v")).distinct()


def near_edges(texts: DataFrame, threshold: float = 0.9, with_ratio: bool = True) -> DataFrame:
    """Star edges (u, v), v the first text of a key and u a later, similar text of it."""
    return key_edges(shared_keys(stored(texts)), threshold, with_ratio).select("u", "v").distinct()


def text_id(c) -> Column:
    """128 bits of a text, as a node of the components."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node reachable, for all nodes of edges (u, v).

    Labels spread by rounds of minimum and pointer jumping; every round is checkpointed in the
    shared folder.
    """
    use_checkpoints(edges)
    both = edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct().checkpoint()
    label = both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")).checkpoint()
    while True:
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("m"))
        step = label.join(near, F.col("node") == F.col("u")).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was")).checkpoint()
        jump = step.select(F.col("node").alias("jn"), F.col("root").alias("jr"))
        step = step.join(jump, F.col("root") == F.col("jn")).select("node", F.least("root", "jr").alias("root"), "was").checkpoint()
        changed = step.filter("root <> was").limit(1).count()
        label = step.select("node", "root")
        if not changed:
            return label


@dataclass(frozen=True)
class GroupStats:
    groups: int
    near_duplicate_rows: int
    entity_groups: int
    entity_grouped_rows: int


def content_groups(
    df: DataFrame, text: str = "text", entity: str | None = None, threshold: float = 0.9, with_ratio: bool = True
) -> DataFrame:
    """df with group_id: texts linked by near duplication or a common non-empty entity share it.

    The id is that of the least text of the group.  A null text has the id of no text.  Only
    128-bit ids travel between the rounds.
    """
    return _grouped(df, text, entity, threshold, with_ratio)[0]


def content_groups_with_stats(
    df: DataFrame, text: str = "text", entity: str | None = None, threshold: float = 0.9, with_ratio: bool = True
) -> tuple[DataFrame, GroupStats]:
    """The same, and the numbers of groups and of rows that linking moved into another row's group.

    near_duplicate_rows counts rows less groups before entities link; entity_grouped_rows counts
    rows of an entity beyond its first.
    """
    out, near = _grouped(df, text, entity, threshold, with_ratio)
    total = df.agg(F.count("*"), F.count_distinct(text)).first()
    linked = near.agg(F.count("*"), F.count_distinct("root")).first() if near is not None else (0, 0)
    entities = (0, 0)
    if entity:
        each = df.filter(F.coalesce(entity, F.lit("")) != "").groupBy(entity).count()
        entities = each.agg(F.count("*"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()
    rows_less_groups = total[0] - (total[1] - linked[0] + linked[1])
    return out, GroupStats(out.select("group_id").distinct().count(), rows_less_groups, int(entities[0]), int(entities[1]))


def _grouped(df: DataFrame, text: str, entity: str | None, threshold: float, with_ratio: bool) -> tuple[DataFrame, DataFrame]:
    df = stored(df)
    texts = df.select(F.col(text).alias("text")).filter("text IS NOT NULL")
    edges = key_edges(shared_keys(texts), threshold, with_ratio).select(text_id(F.col("u")).alias("u"), text_id(F.col("v")).alias("v"))
    near = label = components(edges)
    if entity:
        named = df.filter(F.coalesce(entity, F.lit("")) != "").filter(F.col(text).isNotNull())
        named = named.select(text_id(F.col(text)).alias("u"), F.col(entity).alias("e")).distinct()
        stars = named.join(settled(named.groupBy("e").agg(F.min("u").alias("v"))), "e").filter("u <> v").select("u", "v")
        label = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).union(stars))
    # repeated texts do not change the least
    own = texts.withColumn("_node", text_id(F.col("text"))).join(label, F.col("_node") == F.col("node"))
    least = settled(own.groupBy("root").agg(F.min("text").alias("_least")))
    named_groups = label.join(least, "root").select("node", group_name(F.col("_least")).alias("_group"))
    out = df.withColumn("_node", text_id(F.col(text))).join(named_groups, F.col("_node") == F.col("node"), "left")
    return out.withColumn("group_id", F.coalesce("_group", group_name(F.col(text)))).drop("_node", "node", "_group"), near


def use_checkpoints(df: DataFrame) -> None:
    """Checkpoints go to the folder that the cluster names; a local one only where all runs here."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="winnow-groups-")
        spark.sparkContext.setCheckpointDir(folder)


def group_name(c) -> Column:
    return F.concat(F.lit("g_"), F.substring(F.sha2(c, 256), 1, 16))


def fold_count(test: float = 0.15, valid: float = 0.1) -> int:
    parts = [Fraction(x).limit_denominator(100).denominator for x in (test, valid)]
    return min(math.lcm(*parts), 50)


def strata(df: DataFrame, folds: int, label: str = "label", source: str = "kaynak") -> DataFrame:
    """df with stratum: label|source; rare ones share a source name, or all fall back to the label."""
    pair = F.concat_ws("|", F.col(label).cast("string"), source)
    count = df.groupBy(label, source).count()
    other = F.concat_ws("|", F.col(label).cast("string"), F.lit("diger_kaynak"))
    merged = count.withColumn("s", F.when(F.col("count") < folds, other).otherwise(pair))
    least = merged.groupBy("s").agg(F.sum("count").alias("n")).agg(F.min("n").alias("least"))
    named = merged.crossJoin(least).select(  # one row
        F.col(label).alias("_l"), F.col(source).alias("_s"), F.when(F.col("least") < folds, F.col(label).cast("string")).otherwise(F.col("s")).alias("stratum")
    )
    return df.join(named, F.col(label).eqNullSafe(F.col("_l")) & F.col(source).eqNullSafe(F.col("_s"))).drop("_l", "_s")


def split_name(fold: Column, test: float = 0.15, valid: float = 0.1) -> Column:
    """test, valid or train of a fold; a null fold has none."""
    k = fold_count(test, valid)
    a = max(1, round(test * k))
    return F.when(fold < a, "test").when(fold < a + max(1, round(valid * k)), "valid").when(fold.isNotNull(), "train")


def seeded(c, seed: int) -> Column:
    """48 bits of a value under a seed, the same on every engine."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c), 256), 1, 12), 16, 10).cast("long")


def split_of(group, test: float = 0.15, valid: float = 0.1, seed: int = 42) -> Column:
    """train, valid or test from a group's seeded hash alone: no group is in two splits."""
    return split_name(F.pmod(seeded(group, seed), F.lit(fold_count(test, valid))), test, valid)


def stratified_folds(
    df: DataFrame, folds: int, group: str = "group_id", label: str = "label", source: str = "kaynak", seed: int = 42, shard_groups: int = 10_000
) -> DataFrame:
    """df with stratum and fold: whole groups in one fold, each stratum spread evenly over the folds.

    A group belongs to the stratum that most of its rows have.  Groups of one stratum and size
    class are dealt in turn, in a seeded order, shard by shard of about shard_groups of all groups,
    so no task orders more than a shard.  Fewer groups than folds raise ValueError.
    """
    rows = strata(df, folds, label, source)
    each = rows.groupBy(F.col(group).alias("_g"), "stratum").agg(F.count("*").alias("_n"))
    groups = each.groupBy("_g").agg(F.max_by("stratum", F.struct("_n", "stratum")).alias("_s"), F.sum("_n").alias("_size"))
    many = groups.count()
    if many < folds:
        raise ValueError(f"{folds} folds need as many groups; there are {many}")
    order = seeded(F.col("_g"), seed)
    dealt = groups.withColumn("_class", F.floor(F.log2("_size"))).withColumn("_shard", F.pmod(order, F.lit(-(-many // shard_groups))))
    cell = F.concat_ws("|", "_s", "_class", "_shard")
    place = F.row_number().over(Window.partitionBy("_s", "_class", "_shard").orderBy(order, "_g"))
    dealt = dealt.select("_g", F.pmod(place + seeded(cell, seed), F.lit(folds)).cast("int").alias("fold"))
    return rows.join(dealt, F.col(group) == F.col("_g"), "left").drop("_g")


def balanced_folds(
    df: DataFrame, folds: int, group: str = "group_id", label: str = "label", source: str = "kaynak", seed: int = 42, shard_groups: int = 10_000
) -> DataFrame:
    """df with stratum and fold: whole groups in one fold, and of each stratum as even a share in each fold as groups allow.

    A group's signature is its number of rows in each stratum, so groups that mix labels balance
    too.  Of each signature all folds get equally many groups; the few left over go, the largest
    first, to the fold that most lacks their strata.  The driver sees each distinct signature once;
    groups are dealt by their place in a seeded order within signature and shard, so no task orders
    more than a shard's.  Fewer groups than folds raise ValueError; rows without a group get no fold.
    """
    rows = strata(df, folds, label, source)
    each = rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g"), "stratum").agg(F.count("*").alias("n"))
    signed = each.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("stratum", "n"))).alias("_sign"))
    order = seeded(F.col("_g"), seed)
    groups = settled(signed.withColumn("_sign", F.to_json("_sign")).withColumn("_order", order))
    many = groups.count()
    if many < folds:
        raise ValueError(f"{folds} folds need as many groups; there are {many}")
    groups = groups.withColumn("_shard", F.pmod("_order", F.lit(-(-many // shard_groups))))
    cells = settled(groups.groupBy("_sign", "_shard").agg(F.count("*").alias("_n")))
    totals = {r["_sign"]: r["n"] for r in cells.groupBy("_sign").agg(F.sum("_n").alias("n")).collect()}
    plan = [(sign, n - n % folds, extra) for sign, n, extra in _remainders(totals, folds, seed)]
    plan = df.sparkSession.createDataFrame(plan, "_sign string, _even long, _extra array<int>")
    # places of each signature's shards, one after the other; a row a shard
    before = F.sum("_n").over(Window.partitionBy("_sign").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = settled(cells.withColumn("_from", F.coalesce(before, F.lit(0))).join(plan, "_sign").drop("_n"))
    within = F.row_number().over(Window.partitionBy("_sign", "_shard").orderBy("_order", "_g")) - 1
    dealt = settled(groups.withColumn("_within", within)).join(placed, ["_sign", "_shard"]).withColumn("_place", F.col("_from") + F.col("_within"))
    shift = seeded(F.col("_sign"), seed)
    fold = F.when(F.col("_place") < F.col("_even"), F.pmod(F.col("_place") + shift, F.lit(folds))).otherwise(F.get("_extra", (F.col("_place") - F.col("_even")).cast("int")))
    dealt = settled(dealt.select("_g", fold.cast("int").alias("fold")))
    return rows.join(dealt, F.col(group) == F.col("_g"), "left").drop("_g")


def _remainders(totals: dict[str, int], folds: int, seed: int) -> list[tuple[str, int, list[int]]]:
    """For each signature, its groups and the folds of those that are left when all folds got equally many."""
    parsed = {sign: {x["stratum"]: x["n"] for x in json.loads(sign)} for sign in totals}
    names = sorted({s for held in parsed.values() for s in held})
    place = {s: k for k, s in enumerate(names)}
    whole = np.zeros(len(names))
    for sign, held in parsed.items():
        for s, n in held.items():
            whole[place[s]] += n * totals[sign]
    weight = 1 / np.maximum(whole, 1) ** 2
    lack = np.zeros((folds, len(names)))
    size = np.zeros(folds)
    out = []
    mark = lambda sign: hashlib.sha256(f"{seed}:{sign}".encode()).hexdigest()
    for sign in sorted(totals, key=lambda s: (-sum(parsed[s].values()), mark(s))):
        at = np.array([place[s] for s in parsed[sign]])
        rows = np.array(list(parsed[sign].values()), float)
        extra = []
        for _ in range(totals[sign] % folds):
            cost = lack[:, at] @ (rows * weight[at])
            best = int(np.lexsort((size, np.round(cost, 15)))[0])
            lack[best, at] += rows
            size[best] += rows.sum()
            extra.append(best)
        out.append((sign, totals[sign], extra))
    return out


def overlaps(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """pair and shared: distinct values of a column that two splits share, for each pair of splits."""
    held = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.collect_set(split).alias("s"))  # of three names
    pairs = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.array_contains("s", a) & F.array_contains("s", b)).alias("hit")) for a, b in SPLIT_PAIRS])
    return held.select(F.explode(pairs).alias("x")).groupBy("x.pair").agg(F.count_if("x.hit").alias("shared"))


def check_leakage(df: DataFrame, columns: tuple[str, ...] = ("text", "group_id"), split: str = "split") -> None:
    """Raise if two splits share a text or a group."""
    found = [(c, r["pair"], r["shared"]) for c in columns for r in overlaps(df, c, split).filter("shared > 0").collect()]
    if found:
        raise ValueError("splits overlap: " + ", ".join(f"{pair} share {n} of {c}" for c, pair, n in found))


def fingerprint(df: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Digest of the rows as a multiset: any order and any partitioning give the same.

    Four lanes of 60 bits of each row's SHA-256 are summed, so no task needs more than its rows.
    A null is told from the empty text.
    """
    marked = [F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    rows = df.select(*by, F.sha2(F.concat(*marked), 256).alias("_h"))
    lanes = [F.sum(F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws(",", *lanes, F.count("*").cast("string")), 256).alias("fingerprint"))


def data_version(fingerprints: list[str], version: str = fixed.PREPROCESSING_VERSION) -> str:
    """combined- and 12 digits, of all inputs' digests and the version of the normal forms."""
    return "combined-" + hashlib.sha256(("".join(sorted(fingerprints)) + version).encode()).hexdigest()[:12]


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    rest = [F.col(c) for c in docs.columns if c != text]
    out = docs.select(*rest, F.explode(F.split(text, r"[.\n]+")).alias("s")).withColumn(text, F.trim("s")).filter(F.col(text) != "")
    return out.drop("s")


def word_rows(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(tokens(F.col(text))).alias("word"))


