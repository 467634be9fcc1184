"""Evaluation and calibration of scores (model, label, p) as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, threshold: float, *by: str) -> DataFrame:
    hit, toxic = F.col("p") >= threshold, F.col("label") == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & toxic).alias("tp"), F.count_if(hit & ~toxic).alias("fp"), F.count_if(~hit & ~toxic).alias("tn"), F.count_if(~hit & toxic).alias("fn")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(cells: DataFrame) -> DataFrame:
    """Metrics of confusion cells; a ratio with denominator 0 is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall, special = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return cells.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
            "balanced_accuracy": (recall + special) / 2,
            "precision": precision,
            "recall": recall,
            "f1": _ratio(2 * precision * recall, precision + recall),
            "mcc": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
            "fpr": fp / F.greatest(fp + tn, F.lit(1.0)),
            "fnr": fn / F.greatest(fn + tp, F.lit(1.0)),
        }
    )


#: Ranges of scores that are summed on their own; only their totals meet in one task.
RANGES = 1 << 14


def curve(df: DataFrame) -> DataFrame:
    """Cumulative hits at each distinct score, from the highest on: tp, fp and the totals.

    Sums run within ranges of scores, on top of the totals of all higher ranges.
    """
    slot = F.least(F.greatest(F.floor(F.col("p") * RANGES), F.lit(0)), F.lit(RANGES - 1)).cast("int")
    at = df.groupBy("p").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("_slot", slot)
    totals = at.groupBy("_slot").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    whole = Window.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = totals.select(
        F.col("_slot").alias("_own"), F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_above_pos"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above_n"),
        F.sum("_pos").over(whole).alias("all_pos"), F.sum(F.col("_n") - F.col("_pos")).over(whole).alias("all_neg"),
    )
    down = Window.partitionBy("_slot").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = at.withColumns({"_tp": F.sum("pos").over(down), "_all": F.sum("n").over(down)})
    return sums.join(F.broadcast(before), F.col("_slot") == F.col("_own")).select(
        "p", "pos", "n", (F.col("_tp") + F.col("_above_pos")).alias("tp"),
        (F.col("_all") - F.col("_tp") + F.col("_above_n") - F.col("_above_pos")).alias("fp"), "all_pos", "all_neg",
    )


def average_precision(df: DataFrame) -> DataFrame:
    step = F.col("pos") / F.col("all_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve(df).agg(F.round(F.sum(step), 6).alias("average_precision"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids over distinct scores; null if one class is missing."""
    neg = F.col("n") - F.col("pos")
    area = neg * (F.col("tp") - F.col("pos") / 2.0)
    return curve(df).agg(F.round(F.sum(area) / F.max(F.col("all_pos") * F.col("all_neg")), 6).alias("roc_auc"))


def ece(df: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; p = 0 is in none."""
    edges = [k / bins for k in range(bins + 1)]
    own = F.lit(None).cast("int")
    for k in reversed(range(bins)):
        own = F.when((F.col("p") > edges[k]) & (F.col("p") <= edges[k + 1]), k).otherwise(own)
    total = df.agg(F.count("*").alias("all"))
    each = df.withColumn("bin", own).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("label").alias("acc"))
    return each.crossJoin(total).agg(F.round(F.sum(F.col("n") / F.col("all") * F.abs(F.col("conf") - F.col("acc"))), 6).alias("ece"))


def numpy_edges(bins: int) -> list[float]:
    """Edges as a linear space of doubles: k times the step, the last exact."""
    return [k * (1.0 / bins) for k in range(bins)] + [1.0]


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    edges = F.array(*[F.lit(e) for e in numpy_edges(bins)[1:-1]])
    own = F.size(F.filter(edges, lambda e: F.col("p") >= e))
    return df.groupBy(own.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("label").cast("double")), 6).alias("share"))


def temperatures(count: int = 240, low: float = 0.35, high: float = 4.0) -> list[float]:
    step = (math.log10(high) - math.log10(low)) / (count - 1)
    return [10 ** (math.log10(low) + k * step) for k in range(count)]


def fit_temperature(df: DataFrame) -> DataFrame:
    """The grid's temperature with the least mean log loss; the first of equals.  One class alone gives 1."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(k, t) for k, t in enumerate(temperatures())], "k int, t double")
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    counted = df.groupBy("p", "label").count()
    z = F.log(p / (1 - p)) / F.col("t")
    q = F.lit(1.0) / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))
    loss = F.sum(-F.col("count") * F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q)))
    fits = counted.crossJoin(F.broadcast(grid)).groupBy("k", "t").agg(loss.alias("loss"))
    classes = counted.agg(F.count_distinct("label").alias("_classes"))
    best = fits.agg(F.min_by("t", F.struct("loss", "k")).alias("t"))
    return best.crossJoin(classes).select(F.when(F.col("_classes") > 1, F.col("t")).otherwise(1.0).alias("temperature"))  # one row


def tempered(p: Column, temperature: Column | float) -> Column:
    """A probability after its logit is divided by a temperature; within sigmoid(-40) and sigmoid(40)."""
    own = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.log(own / (1 - own)) / (temperature if isinstance(temperature, Column) else F.lit(temperature))
    return F.lit(1.0) / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))


def probability_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Counts of scores per label and bin of equal width over 0 to 1, and their density within the label."""
    own = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    n = df.groupBy("label", own.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("density", F.round(F.col("n") * bins / F.sum("n").over(Window.partitionBy("label")), 6))


def confusion_shares(df: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Confusion cells as shares of each true label: tn and fp of label 0, fn and tp of label 1."""
    cells = confusion(df, threshold, *by)
    neg, pos = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    shares = {c: F.round(_ratio(F.col(c), neg if c in ("tn", "fp") else pos), 6) for c in ("tn", "fp", "fn", "tp")}
    return cells.select(*by, *[v.alias(k) for k, v in shares.items()])


def history_curves(history: DataFrame, *metrics: str) -> DataFrame:
    """Long form of epoch metrics: epoch, metric, value; epochs without a value are left out."""
    return history.unpivot(["epoch"], list(metrics), "metric", "value").filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))


def select_threshold(df: DataFrame, budget: float) -> DataFrame:
    """Of 750 even thresholds and 250 quantiles the best by f1, recall, precision within a budget of false positives."""
    even = [0.5 + k * 0.499 / 749 for k in range(750)]
    share = [k / 249 for k in range(250)]
    quantiles = df.agg(F.percentile("p", F.array(*[F.lit(s) for s in share])).alias("q"))
    grid = quantiles.select(F.explode(F.array_distinct(F.concat("q", F.array(*[F.lit(e) for e in even])))).alias("t")).filter("t BETWEEN 0.5 AND 0.999")
    counted = df.groupBy("p").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n"))
    cells = counted.crossJoin(F.broadcast(grid)).groupBy("t").agg(
        F.sum(F.when(F.col("p") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") >= F.col("t"), F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("p") < F.col("t"), F.col("n") - F.col("pos")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("p") < F.col("t"), F.col("pos")).otherwise(0)).alias("fn"),
    )
    good = metrics(cells).filter(F.col("fpr") <= budget)
    best = good.agg(F.max_by("t", F.struct("f1", "recall", "precision", -F.col("t"))).alias("t"))
    return best.select(F.coalesce("t", F.lit(0.999)).alias("threshold"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(F.array(e), lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]


def focal_loss(p: Column, label: Column, gamma: float = 2.0, weights: tuple[float, float] = (1.0, 1.0)) -> Column:
    pt = F.when(label == 1, p).otherwise(1 - p)
    return F.pow(1 - pt, gamma) * F.when(label == 1, weights[1]).otherwise(weights[0]) * -F.log(F.greatest(pt, F.lit(1e-12)))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    total = df.agg(F.count("*").alias("n"))
    return df.groupBy(label).agg(F.count("*").alias("own")).crossJoin(total).select(
        label, F.round(F.least(F.greatest(F.col("n") / (2.0 * F.col("own")), F.lit(0.25)), F.lit(4.0)), 6).alias("weight")
    )
