"""N-gram Jaccard join: classes of documents whose shingle sets are linked, by a count-vector R-tree.

1. Documents with equal sets collapse to one representative (copies never meet in pairs).
2. Any two linked sets share one of their rarest shingles, so many as the threshold leaves room
   for; these keys bring candidates together.  "Rare" follows a fixed-size count of all
   shingles, so that passages which many documents share are keys of last resort.  Any order
   gives the same result.
3. Shingles are hashed to coordinates; the counts per coordinate make each set a point.  The
   points of one key meet in an R-tree: the summed minima of two points (or of a point and a box)
   bound the overlap from above.  What the bound leaves is connected to candidate groups.
4. A group's texts meet in one task, again in an R-tree; pairs that the bound leaves and that are
   not connected yet are verified on their sets.
A group over the limits of a task is cut into chunks.  Each meets some documents that all chunks of
its group share; then only what is outside the group's main class meets all other chunks.  A key
over the limits is cut into chunks and every pair of chunks meets.  So no limit drops a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .tables import discard, materialize, read

SLOT_BITS = 20
#: A slot of the shingle count is reported by a task from this many times its mean load on.
OVER_MEAN = 8
COORDINATES = 64
FANOUT = 16
#: Documents of a large group, about, that all its chunks share.
HUBS = 32
#: Sets from FINE_SIZE shingles on have four times the coordinates, from 4 * FINE_SIZE on 16 times,
#: and so on; sums of a finer point's coordinates give the coarser one.  So a coordinate counts
#: four shingles at most on average: with sixteen, one in ten pairs of unrelated sets passes the
#: bound, and candidate groups grow faster than the input.
FINE_SIZE = 250


def level_of(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(np.log(np.maximum(sizes, 1) / FINE_SIZE) / np.log(4)).astype(np.int64) + 1, 0)


def shingle_sets(words: W.Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    hashes = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    grams = W.gram_hashes(hashes, n)
    for lo, hi in zip(words.starts[:-1], words.starts[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        elif hi > lo:
            yield np.array([xxhash.xxh3_64_intdigest(hashes[lo:hi].tobytes(), int(hi - lo))], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def point(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    return np.bincount((shingles % np.uint64(coordinates)).astype(np.int64), minlength=coordinates)


def packed_point(shingles: np.ndarray) -> bytes:
    """A point as fine as its set is long, of one, two or four bytes a coordinate."""
    counts = point(shingles, COORDINATES << 2 * int(level_of(np.array([len(shingles)]))[0]))
    top = int(counts.max(initial=0))
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def unpacked_points(blobs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Points with as many coordinates as the shortest set has."""
    levels = level_of(sizes)
    width = COORDINATES << 2 * int(levels.min())
    out = np.empty((len(blobs), width), np.uint16 if sizes.max() < 1 << 16 else np.int32)
    for k, (b, level) in enumerate(zip(blobs, levels.tolist(), strict=True)):
        own = COORDINATES << 2 * level
        out[k] = np.frombuffer(b, f"<u{len(b) // own}").reshape(-1, width).sum(axis=0)
    return out


def frequent_slots(docs: DataFrame, n: int) -> np.ndarray:
    """Rank class of each slot of a fixed-size shingle count over all texts: 0, or log2 of its count.

    The table has 2^20 bytes whatever the input; tasks report only slots far above their mean.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in W.steps(batches):
            words = W.split(batch.column("text"), lower=True)
            if len(words.codes) >= n:
                grams = W.gram_hashes(words.hashes()[words.codes], n)
                slots += np.bincount((grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(slots))
        high = np.flatnonzero(slots >= max(OVER_MEAN, OVER_MEAN * slots.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(high, pa.int32()), pa.array(slots[high], pa.int64())], ["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[rows["slot"].to_numpy(np.int64)] = np.log2(rows["n"].to_numpy(np.float64)).astype(np.uint8) if len(rows) else 0
    return out


class CountRTree:
    """Points of counts in packed nodes; search() bounds overlaps by summed coordinate minima."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        half = counts.shape[1] // 2
        self.order = np.lexsort((counts[:, 0], counts[:, :half].sum(axis=1), sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # upper corner and least size of each node
        high, least = self.counts, self.sizes
        while len(high) > FANOUT:
            cuts = np.arange(0, len(high), FANOUT)
            high, least = np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((high, least))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions of points that the bound leaves as partners, most promising first."""
        at = np.arange(len(self.levels[-1][0] if self.levels else self.counts))
        for depth in range(len(self.levels), -1, -1):
            high, least = self.levels[depth - 1] if depth else (self.counts, self.sizes)
            bound = np.minimum(high[at], point).sum(axis=1)
            near = (100 + percent) * bound >= percent * (size + least[at])
            at, bound = at[near], bound[near]
            if depth:
                width = len(self.levels[depth - 2][0]) if depth > 1 else len(self.counts)
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < width]
        return self.order[at[np.argsort(-bound, kind="stable")]]


def local_roots(sets: list[np.ndarray], ids: list, percent: int) -> list[int]:
    """Position of each set's root in the forest of exact links; equal ids are one node."""
    parent = list(range(len(sets)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    first: dict = {}
    for k, i in enumerate(ids):
        union(first.setdefault(i, k), k)
    sizes = np.array([len(s) for s in sets], np.int64)
    width = COORDINATES << 2 * int(level_of(sizes[sizes > 0]).min(initial=3))
    counts = np.stack([point(s, width) for s in sets]).astype(np.int32)
    tree = CountRTree(counts, sizes)
    # the most central sets first: what they connect needs no check among itself
    central = np.abs(counts - counts.mean(axis=0)).sum(axis=1)
    for k in np.argsort(central, kind="stable").tolist():
        if not sizes[k]:
            continue
        own = find(k)
        near = [j for j in tree.search(counts[k], int(sizes[k]), percent).tolist() if sizes[j] and find(j) != own]
        for lo in range(0, len(near), 512):
            part = [j for j in near[lo : lo + 512] if find(j) != find(k)]
            if not part:
                continue
            flat = np.concatenate([sets[j] for j in part])
            at = np.minimum(np.searchsorted(sets[k], flat), sizes[k] - 1)
            ends = np.cumsum(sizes[part])
            common = np.diff(np.concatenate([[0], np.cumsum(sets[k][at] == flat)[ends - 1]]))
            for j, c in zip(part, common.tolist(), strict=True):
                if 100 * c >= percent * (int(sizes[k]) + int(sizes[j]) - c):
                    union(k, j)
    return [find(k) for k in range(len(sets))]


def bounded_stars(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions (member, root) that connect all pairs which the bound leaves."""
    n = len(ids)
    parent = np.arange(n)
    tree = CountRTree(counts, sizes)
    for k in range(n):
        near = tree.search(counts[k], int(sizes[k]), percent)
        roots = np.unique(parent[near])
        if len(roots) > 1:
            parent[np.isin(parent, roots)] = roots[0]
    return [(k, int(r)) for k, r in enumerate(parent) if k != r]


def block_edges(keys: np.ndarray, ids: np.ndarray, blobs: list[bytes], sizes: np.ndarray, percent: int) -> tuple[list, list]:
    """Candidate edges (positions) inside the runs of equal keys; keys are sorted."""
    left, right = [], []
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    run = np.diff(cuts)
    short = np.repeat(run <= 4, run)
    levels = level_of(sizes)
    for step in (1, 2, 3):  # pairs of short runs, all at once
        a = np.flatnonzero(short[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else np.empty(0, np.int64)
        a = a[100 * np.minimum(sizes[a], sizes[a + step]) >= percent * np.maximum(sizes[a], sizes[a + step])]
        a = a[ids[a] != ids[a + step]]
        level = np.minimum(levels[a], levels[a + step])
        for own in np.unique(level).tolist():
            part = a[level == own]
            for lo in range(0, len(part), 2048):
                x = part[lo : lo + 2048]
                both = unpacked_points([blobs[k] for k in x.tolist()] + [blobs[k + step] for k in x.tolist()], np.concatenate([sizes[x], sizes[x + step]]))
                overlap = np.minimum(both[: len(x)], both[len(x) :]).sum(axis=1)
                x = x[(100 + percent) * overlap >= percent * (sizes[x] + sizes[x + step])]
                left += x.tolist()
                right += (x + step).tolist()
    for k in np.flatnonzero(run > 4).tolist():
        lo, hi = int(cuts[k]), int(cuts[k + 1])
        for own in np.unique(levels[lo:hi]).tolist():
            # a pair belongs to its shorter set's level, so the next level's shortest sets join in
            reach = 100 * (FINE_SIZE << 2 * own)
            at = lo + np.flatnonzero((levels[lo:hi] == own) | (levels[lo:hi] == own + 1) & (percent * sizes[lo:hi] <= reach))
            if len(at) > 1:
                counts = unpacked_points([blobs[j] for j in at.tolist()], sizes[at])
                for member, root in bounded_stars(ids[at], counts, sizes[at], percent):
                    left.append(int(at[member]))
                    right.append(int(at[root]))
    return left, right


def jaccard_classes(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 4,
    percent: int = 85,
    task_shingles: int = 2_000_000,
    task_documents: int = 256,
    task_points: int = 8192,
) -> DataFrame:
    """Class of each document under links of Jaccard similarity percent / 100 or more.

    Returns one row per input row: doc_id, n_shingles, component_id (the least doc_id that links
    reach, its own included).

    * Texts are taken whole, whatever their length: shingles travel as hashes.
    * Words are folded A-Z; a text of fewer than n words is one shingle, its whole sequence.
    * A null, empty or blank text has no shingles, is linked with nothing and is its own class.
    * Rows that repeat a doc_id are one node with several sets.  A null doc_id takes part in no
      link and has a null component_id.  Ties cannot occur, as classes do not depend on order.
    * An empty table gives an empty result.  Other columns are ignored, whatever their names.
    * task_shingles and task_documents limit a chunk of a group, task_points one of a key; larger
      groups and keys are cut into chunks, and still every pair is decided.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()
    rank = spark.sparkContext.broadcast(frequent_slots(docs, n))  # 1 MB, whatever the input

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - SLOT_BITS)
        for batch in W.steps(batches):
            sizes, marks, keys, points = [], [], [], []
            for s in shingle_sets(W.split(batch.column("text"), lower=True), n):
                sizes.append(len(s))
                points.append(packed_point(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                marks.append(np.frombuffer(digest, "<i8"))
                if len(s):
                    order = np.argsort(rank.value[(s >> shift).astype(np.int64)], kind="stable")
                    s = s[order[: prefix_length(len(s), percent)]]
                keys.append(W.signed(s))
            both = np.array(marks, np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists, pa.array(points, pa.binary())],
                ["_id", "_n", "_f1", "_f2", "_keys", "_point"],
            )

    sketches = materialize(docs.mapInArrow(sketch, f"_id {kind}, _n long, _f1 long, _f2 long, _keys array<long>, _point binary"))
    sets = materialize(sketches.select("_id", "_n", "_f1", "_f2"))
    real = sets.filter("_n > 0 AND _id IS NOT NULL")
    # written, so that adaptive execution can split the joins of a set that very many documents have
    classes = materialize(real.groupBy("_f1", "_f2").agg(F.min("_id").alias("_rep")))
    members = sets.join(classes.hint("merge"), ["_f1", "_f2"], "left").select("_id", "_n", "_rep")
    own = sketches.filter("_n > 0").join(classes, ["_f1", "_f2"]).filter("_id = _rep")
    # keys that the same documents hold are one: near copies share hundreds, and need to meet once
    holders = Window.partitionBy("_key")
    live = materialize(
        own.select("_rep", F.explode("_keys").alias("_key"))
        .select("_rep", F.count("*").over(holders).alias("_many"), F.bit_xor(F.xxhash64("_rep")).over(holders).alias("_all"))
        .filter("_many > 1")
        .select(F.xxhash64("_many", "_all").alias("_key"), "_rep")
        .distinct()
    )
    met = live.select(F.col("_rep").alias("_of")).distinct()
    points = materialize(own.select(F.col("_rep").alias("_of"), "_n", "_point").join(met, "_of", "left_semi"))
    discard(sketches)
    blocks = live.groupBy("_key").agg(F.ceil(F.count("*") / task_points).cast("int").alias("_parts")).filter("_parts > 1")
    part = F.pmod(F.xxhash64("_of"), F.col("_parts")).cast("int")
    pointed = (
        live.join(blocks, "_key", "left")
        .join(points, F.col("_rep") == F.col("_of"))
        .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        .withColumn("_part", part)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_block", F.xxhash64("_key", F.least("_part", "_other"), F.greatest("_part", "_other")))
        .select("_block", F.col("_rep").alias("_id"), "_n", "_point")
    )

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidate edges of each block, in a stream sorted by block; the last block waits."""
        rest: pa.Table | None = None

        def edges(table: pa.Table) -> pa.RecordBatch:
            ids = table.column("_id").combine_chunks()
            code = ids.dictionary_encode().indices.to_numpy()
            sizes = table.column("_n").to_numpy()
            a, b = block_edges(table.column("_block").to_numpy(), code, table.column("_point").to_pylist(), sizes, percent)
            pairs = np.unique(np.stack([code[a], code[b]]), axis=1) if a else np.empty((2, 0), np.int64)
            first = np.unique(code, return_index=True)[1]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(first[x])) for x in pairs], ["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            block = table.column("_block").to_numpy()
            cut = int(np.searchsorted(block, block[-1], side="left"))
            if cut:
                yield edges(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield edges(rest)
        W.release()

    near = connected_components(
        pointed.repartition("_block").sortWithinPartitions("_block").mapInArrow(candidates, f"u {kind}, v {kind}")
    )
    nodes = near.union(near.select(F.col("v"), F.col("v")).distinct()).toDF("_of", "_group")
    sized = nodes.join(real.groupBy(F.col("_id").alias("_of")).agg(F.sum("_n").alias("_size")), "_of")
    tasks = F.greatest(F.ceil(F.sum("_size") / task_shingles), F.ceil(F.count("*") / task_documents)).cast("int")
    sized = materialize(sized)
    chunks = materialize(sized.groupBy("_group").agg(tasks.alias("_chunks"), F.count("*").alias("_many")))

    def least_edges(nodes: list, roots: list[int], kind: pa.DataType) -> pa.Table:
        least: dict[int, object] = {}
        for node, r in zip(nodes, roots, strict=True):
            least[r] = node if r not in least else min(least[r], node)
        rows = {(node, least[r]) for node, r in zip(nodes, roots, strict=True) if node != least[r]}
        return pa.table({"u": pa.array([a for a, _ in rows], kind), "v": pa.array([b for _, b in rows], kind)})

    def link(table: pa.Table) -> pa.Table:
        """Edges between nodes (texts that are known to be connected share one) by exact links of their texts."""
        nodes = table.column("_node").to_pylist()
        roots = local_roots(list(shingle_sets(W.split(table.column("text"), lower=True), n)), nodes, percent)
        W.release()
        return least_edges(nodes, roots, table.column("_node").type)

    def linked_in(dealt: DataFrame) -> DataFrame:
        """Edges of rows (_of, _node, _group, _a, _b): the texts of one group and task meet."""
        texts = dealt.join(docs, F.col("_of") == F.col("_id")).select("_group", "_a", "_b", "_node", "text")
        return texts.groupBy("_group", "_a", "_b").applyInArrow(link, f"u {kind}, v {kind}")

    # a doc_id with several sets links their classes
    several = real.groupBy("_id").agg(F.min("_f1").alias("_a1"), F.max("_f1").alias("_b1"), F.min("_f2").alias("_a2"), F.max("_f2").alias("_b2"))
    several = several.filter("_a1 <> _b1 OR _a2 <> _b2").select("_id")
    same_id = real.join(several, "_id").join(classes, ["_f1", "_f2"]).select(F.col("_id").alias("u"), F.col("_rep").alias("v"))
    # every chunk meets some documents that all chunks of its group share
    own = F.pmod(F.xxhash64("_of"), F.col("_chunks")).cast("int")
    hub = (F.col("_chunks") > 1) & (F.pmod(F.xxhash64(F.lit(13), "_of"), F.col("_many")) < HUBS)
    every = F.sequence(F.lit(0), F.col("_chunks") - 1)
    dealt = sized.join(chunks, "_group").select("_of", F.col("_of").alias("_node"), "_group", F.explode(F.when(hub, every).otherwise(F.array(own))).alias("_a"), F.lit(0).alias("_b"))
    linked = connected_components(linked_in(dealt).union(same_id))
    large = chunks.filter("_chunks > 1")
    if not large.isEmpty():
        # what is not in the main class of its group meets all chunks of the group
        placed = sized.join(large, "_group").join(linked, F.col("_of") == F.col("u"), "left").withColumn("_node", F.coalesce("v", "_of")).drop("u", "v")
        main = placed.groupBy("_group", "_node").count().groupBy("_group").agg(F.max_by("_node", F.struct("count", "_node")).alias("_main"))
        placed = materialize(placed.join(main, "_group").withColumn("_rest", F.col("_node") != F.col("_main")))
        parts = placed.filter("_rest").groupBy("_group").agg(tasks.alias("_parts"))
        both = placed.join(parts, "_group")
        rows = F.sequence(F.lit(0), F.col("_parts") - 1)
        part = F.pmod(F.xxhash64(F.lit(17), "_of"), F.col("_parts")).cast("int")
        of_all = both.select("_of", "_node", "_group", F.explode(rows).alias("_a"), own.alias("_b"))
        of_rest = both.filter("_rest").select("_of", "_node", "_group", part.alias("_a"), F.explode(every).alias("_b"))
        linked = connected_components(linked.union(linked_in(of_all.union(of_rest).distinct())))
    out = members.join(linked.hint("merge"), F.col("_rep") == F.col("u"), "left")  # both grow with the input, and may not be sent whole
    return out.select(
        F.col("_id").alias(doc_id), F.col("_n").alias("n_shingles"), F.coalesce("v", "_rep", "_id").alias("component_id")
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {W.FOLDED_WORDS_SQL} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reached(node, seen) AS (SELECT u, v FROM both_ways UNION SELECT r.node, b.v FROM reached r JOIN both_ways b ON r.seen = b.u),
least AS (SELECT node, min(seen) AS root FROM reached GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON node = doc_id
"""
