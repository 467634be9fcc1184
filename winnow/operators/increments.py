"""Near-duplicate groups of texts that come in batches: after each batch the groups of one run over all.

Kept as tables in one folder: texts, holders (hashes of a text and of its keys), edges (key, u, v) and
groups (node, root), each as parts that carry the batch that wrote them.  A batch brings texts; only
keys that they hold and share are looked at, and only those are spelled out again from their texts.  Where a key's first text stays, its edges stay and the new holders are compared with
it; where a lesser text comes, all holders are compared anew and old edges of the key go.  Only the
components that lost or won an edge are joined again.  Old parts are never rewritten: a key's edges
and a node's group are those of the last batch that wrote them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.operators import tables


class Groups:
    """The kept state of one collection in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, threshold: float = 0.9, with_ratio: bool = True) -> None:
        self.spark, self.folder, self.threshold, self.with_ratio = spark, folder.rstrip("/"), threshold, with_ratio
        self.batches = 0

    _SCHEMAS = {
        "texts": "text string, node binary",
        "holders": "n long, ks array<long>",
        "edges": "key string, u binary, v binary",
        "groups": "node binary, root binary",
    }

    def _part(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch:06d}"

    def _kept(self, name: str) -> DataFrame:
        """All parts so far, with batch; those of a run that broke off are not among them."""
        schema = self._SCHEMAS[name]
        if not self.batches:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        reader = self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.folder}/{name}")
        return reader.parquet(*[self._part(name, k) for k in range(1, self.batches + 1)])

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = self._part(name, self.batches + 1)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self._SCHEMAS[name]).parquet(path)

    def current_edges(self) -> DataFrame:
        """Edges of each key's last writing; a key that lost all has a row without nodes."""
        kept = self._kept("edges")
        last = kept.groupBy("key").agg(F.max("batch").alias("batch"))
        return kept.join(last, ["key", "batch"]).filter("u IS NOT NULL").select("key", "u", "v")

    def current_groups(self) -> DataFrame:
        return self._kept("groups").groupBy("node").agg(F.max_by("root", "batch").alias("root"))

    def add(self, rows: DataFrame, text: str = "text") -> None:
        """Take a batch.  Null texts and texts that earlier batches brought change nothing."""
        tables.use_checkpoints(rows)
        old_texts = self._kept("texts").select("text")
        fresh = rows.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct().join(old_texts, "text", "left_anti")
        fresh = self._write(fresh.select("text", tables.text_id(F.col("text")).alias("node")), "texts")
        old_hashes, hashes = self._kept("holders").drop("batch"), self._write(tables.key_hashes(fresh.select("text")).groupBy("n").agg(F.collect_list("k").alias("ks")), "holders")
        # keys that a text of the batch shares with any other
        met = [x.select(F.explode("ks").alias("k"), "n", F.lit(new).alias("new")) for x, new in ((old_hashes, 0), (hashes, 1))]
        each = Window.partitionBy("k")
        live = met[0].union(met[1]).select("k", "n", F.count("*").over(each).alias("many"), F.max("new").over(each).alias("any"))
        live = tables.stored(live.filter("many > 1 AND any = 1").select("k", "n"))
        keyed, older = tables.keys_among(fresh, live), tables.keys_among(old_texts, live)
        keyed, older = (x.select("key", "text", "w") for x in (keyed, older))
        met = keyed.groupBy("key").agg(F.min("text").alias("new_first")).checkpoint()
        before = older.join(met.select("key"), "key", "left_semi").checkpoint()
        old_first = before.groupBy("key").agg(F.min("text").alias("old_first"))
        kinds = met.join(old_first, "key", "left").withColumn("moved", F.col("old_first").isNull() | (F.col("new_first") < F.col("old_first"))).checkpoint()
        # all holders of keys whose first text is new; else the new holders and the first
        moved, stayed = kinds.filter("moved").select("key"), kinds.filter("NOT moved").select("key", "old_first")
        whole = before.union(keyed).join(moved, "key", "left_semi")
        first = before.join(stayed, "key").filter("text = old_first").drop("old_first")
        more = keyed.join(stayed.select("key"), "key", "left_semi").union(first)
        found = tables.key_edges(whole.union(more), self.threshold, self.with_ratio)
        found = found.select("key", tables.text_id(F.col("u")).alias("u"), tables.text_id(F.col("v")).alias("v"))
        now = self.current_edges()
        kept = now.join(stayed.select("key"), "key", "left_semi")
        gone = now.join(moved, "key", "left_semi").select("u", "v").checkpoint()
        # a moved key without edges says so, if it had any
        blank = now.join(moved, "key", "left_semi").select("key").distinct().join(found.select("key").distinct(), "key", "left_anti")
        written = found.union(kept.join(found.select("key").distinct(), "key", "left_semi")).union(blank.select("key", F.lit(None).cast("binary"), F.lit(None).cast("binary"))).distinct()
        wrote = self._write(written, "edges")
        touched = wrote.filter("u IS NOT NULL").select("u", "v").union(gone)
        nodes = touched.select(F.col("u").alias("node")).union(touched.select("v")).distinct()
        groups = self.current_groups()
        # the components that the batch meets, whole, with all their edges as they are now
        roots = groups.join(nodes, "node", "left_semi").select("root").distinct()
        members = groups.join(roots, "root", "left_semi").select("node").union(nodes).distinct().checkpoint()
        self.batches += 1
        edges = self.current_edges().select("u", "v").distinct().join(members.withColumnRenamed("node", "u"), "u", "left_semi")
        joined = tables.components(edges)
        alone = members.join(joined, "node", "left_anti").select("node", F.col("node").alias("root"))
        self.batches -= 1
        self._write(joined.select("node", "root").union(alone), "groups")
        self.batches += 1

    def groups(self) -> DataFrame:
        """text and group_id of all texts so far, as tables.content_groups gives them."""
        texts, linked = self._kept("texts").select("text", "node"), tables.stored(self.current_groups())
        least = texts.join(linked, "node").groupBy("root").agg(F.min("text").alias("least"))
        named = linked.join(least, "root").select("node", tables.group_name(F.col("least")).alias("group"))
        return texts.join(named, "node", "left").select("text", F.coalesce("group", tables.group_name(F.col("text"))).alias("group_id"))
