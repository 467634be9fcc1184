"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Words are counted once, into a narrow table.  Targets come from source totals on the driver (one row per source).  Each source's documents are
dealt to shards and laid end to end in a seeded order; a shard is a row of blocks of nearly equal
size.  Seats (blocks to take) go to sources, and within a source to its shards, by the highest
quotients votes / (2 * seats + 1).  Which blocks of a shard are taken once more than the others
follows from a seeded permutation, so no ranking of blocks is needed and reruns agree.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .tables import carried, materialize, read, uncarried

WORD = r"[^\x20\x09-\x0D]+"
#: Steps of the block permutation; the first that shares no factor with a shard's block count serves.
STEPS = (2654435761, 2246822519, 3266489917, 668265263, 374761393)

#: So many sources are broadcast with their plan; more meet their documents in a shuffled join.
BROADCAST_SOURCES = 10_000


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size; what is above is shared anew."""
    out = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    rest = total
    while open_:
        weight = sum(weights[k] for k in sorted(open_))
        above = [k for k in sorted(open_) if rest * weights[k] / weight > cap * sizes[k]]
        if not above:
            for k in open_:
                out[k] = rest * weights[k] / weight
            break
        for k in above:
            out[k] = float(cap * sizes[k])
            open_.discard(k)
        rest = total - sum(out[k] for k in range(len(out)) if k not in open_)
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 * held + 1), at most most[k] for k; ties go to the first."""
    total = sum(votes)
    held = [0] * len(votes)
    if total <= 0:
        return held
    seats = min(seats, sum(m for m, v in zip(most, votes, strict=True) if v > 0))
    # a start that no party exceeds in the end: a seat less than the rounded share
    held = [max(0, min(m, math.floor(v * seats / total) - 1)) for v, m in zip(votes, most, strict=True)]
    missing = seats - sum(held)
    while missing < 0 or not _is_start(votes, held):
        held = [max(0, h - 1 - h // 8) for h in held]
        missing = seats - sum(held)
    heap = [(-v / (2 * h + 1), k) for k, (v, h) in enumerate(zip(votes, held, strict=True)) if v > 0 and h < most[k]]
    heapq.heapify(heap)
    for _ in range(missing):
        _, k = heapq.heappop(heap)
        held[k] += 1
        if held[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * held[k] + 1), k))
    return held


def _is_start(votes: list[float], held: list[int]) -> bool:
    """Whether the quotients won so far all lie above every next one of parties without a bound."""
    won = [v / (2 * h - 1) for v, h in zip(votes, held, strict=True) if h]
    ahead = max((v / (2 * h + 1) for v, h in zip(votes, held, strict=True)), default=0.0)
    return not won or min(won) >= ahead or max(held) == 0


def mix(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    block_tokens: int = 64,
    least_blocks: int = 20_000,
    shard_rows: int = 2_000,
    seed: int = 17,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document the mix takes, and which.

    Returns one row per input row: doc_id, source, size, source_size, target, taken, the two
    block numbers and figures behind them (spans: start, end, times, in words), then the carried
    columns.  Blocks have about block_tokens words, or less where the corpus would have under
    least_blocks of them, so that targets are met to a small share of the corpus at any size.

    * Texts count whole, whatever their length.
    * Size counts words; a null or empty text has size 0, takes part and gives nothing.
    * A null source is a source of its own, after all others; weights repeat in code point order.
    * Repeated rows are documents of their own; equal rows are interchangeable in the seeded order.
    * A null doc_id is kept as null.  An empty table gives an empty result.
    * The driver holds one row per source, a worker one per shard (of about shard_rows rows) of a
      source.
    * Other columns are ignored unless carried, whatever their names.
    """
    docs = documents.select(
        F.col(f"`{doc_id}`").alias("_id"),
        F.col(f"`{source}`").alias("_source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("_order"),
        carried(carry).alias("_carry"),
    )
    spark = documents.sparkSession
    facts = materialize(docs.drop("_carry"))
    if not carry:
        docs = facts.withColumn("_carry", carried(carry))
    totals = facts.groupBy("_source").agg(F.sum("_size").alias("tokens"), F.count("*").alias("rows")).collect()
    totals.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [int(r["tokens"]) for r in totals]
    weight = [float(weights[k % len(weights)]) for k in range(len(totals))]
    targets = water_fill(sizes, weight, share * sum(sizes), cap)
    block = max(1, min(block_tokens, sum(sizes) // least_blocks))
    most = [cap * max(1, round(s / block)) if s else 0 for s in sizes]
    seats = sainte_lague(targets, round(sum(targets) / block), most)
    kind = docs.schema["_source"].dataType.simpleString()
    plan = spark.createDataFrame(
        [(r["_source"], s, t, q, max(1, -(-r["rows"] // shard_rows))) for r, s, t, q in zip(totals, sizes, targets, seats, strict=True)],
        f"_of {kind}, source_size long, target double, _seats long, _shards long",
    )
    few = F.broadcast if len(totals) <= BROADCAST_SOURCES else lambda df: df

    def dealt(df: DataFrame) -> DataFrame:
        key = F.when(F.col("_source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("_source").cast("string")))
        own = df.join(few(plan), F.col("_source").eqNullSafe(F.col("_of")))
        return own.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_shards"))).withColumn("_key", key)

    def quotas(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("_shard")
        blocks = [max(1, round(t / block)) if t else 0 for t in cells["_tokens"]]
        held = sainte_lague([float(t) for t in cells["_tokens"]], int(cells["_seats"].iloc[0]), [cap * b for b in blocks])
        steps = [next((s for s in STEPS if math.gcd(s, b) == 1), 1) if b else 1 for b in blocks]
        return pd.DataFrame({"_key": cells["_key"], "_cell": cells["_shard"], "_tokens": cells["_tokens"], "_blocks": blocks, "_quota": held, "_step": steps})

    cells = (
        dealt(facts)
        .groupBy("_key", "_shard")
        .agg(F.sum("_size").alias("_tokens"), F.first("_seats").alias("_seats"))
        .groupBy("_key")
        .applyInPandas(quotas, "_key string, _cell long, _tokens long, _blocks long, _quota long, _step long")
        .withColumnRenamed("_key", "_cell_key")
    )
    lined = dealt(docs).withColumn(
        "_start",
        F.sum("_size").over(
            Window.partitionBy("_key", "_shard").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        - F.col("_size"),
    )
    joined = lined.join(cells, (F.col("_key") == F.col("_cell_key")) & (F.col("_shard") == F.col("_cell")))
    n, t = F.col("_blocks"), F.col("_tokens")

    def at(token: Column) -> Column:
        return F.expr("0") + F.floor(((token + 1) * n - 1) / t)

    def span(b: Column) -> Column:
        low = F.greatest(F.floor(b * t / n), F.col("_start")) - F.col("_start")
        high = F.least(F.floor((b + 1) * t / n), F.col("_start") + F.col("_size")) - F.col("_start")
        place = F.pmod(b * F.pmod(F.col("_step"), n) + F.lit(seed), n)
        times = F.floor(F.col("_quota") / n) + F.when(place < F.pmod(F.col("_quota"), n), 1).otherwise(0)
        return F.struct(low.cast("long").alias("start"), high.cast("long").alias("end"), times.cast("long").alias("times"))

    spans = F.when(
        F.col("_size") > 0,
        F.transform(F.sequence(at(F.col("_start")), at(F.col("_start") + F.col("_size") - 1)), span),
    ).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,times:bigint>>"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]) * x["times"])
    return joined.withColumn("spans", spans).select(
        F.col("_id").alias(doc_id),
        F.col("_source").alias(source),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        taken.alias("taken"),
        "spans",
        *uncarried(carry),
    )


def taken_texts(mixed: DataFrame, text: str = "text", cap: int = 2) -> DataFrame:
    """The mix as documents: one row per pass over a document, with the words that the pass takes.

    A pass that takes a whole text leaves it unchanged; the words of other passes are joined by
    one space.  Passes that take nothing give no row.  mixed must carry the text.
    """
    passes = mixed.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(cap)))).withColumn(
        "_spans", F.filter("spans", lambda x: x["times"] >= F.col("_pass"))
    )
    words = F.array(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), 1))
    parts = F.transform(
        words,
        lambda w: F.array_join(
            F.flatten(F.transform("_spans", lambda x: F.slice(w, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), " "
        ),
    )[0]
    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]) == F.col("size")
    return passes.filter(F.size("_spans") > 0).withColumn(text, F.when(whole, F.col(text)).otherwise(parts)).drop("_pass", "_spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
