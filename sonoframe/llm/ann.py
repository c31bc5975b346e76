"""Approximate nearest neighbours by cosine with a hierarchical k-means tree.

The tree is fitted by spherical k-means on a sample of at most sample_rows vectors (seeded hash). A leaf holds about the root of the
number of vectors, so leaves and their size grow alike; a leaf needs SAMPLE sampled vectors, which bounds the leaves of one
tree at sample_rows / SAMPLE = 4,096 (16.8 million vectors by the root; beyond that leaves grow with the table). Every vector is
put into a leaf. A query walks the tree best bin first: a priority queue holds nodes by the query's cosine to their centroids; the
best is opened until enough leaves were visited.

How many is calibrated: for a bounded set of queries the true neighbours among all rows are found by brute
force, and leaf visits are widened until `recall` of them lie in visited leaves. With no more queries than that set has
(`calibration`) and a recall near one, the result is exact.

Leaves are packed into bins of at most about bin_rows vectors; a larger leaf is cut over several bins. A query goes once to
each bin that has a leaf of its list, and leaves it with at most k rows. A bin that more than query_rows queries visit is copied and
its queries are dealt over the copies, so a task's group is bounded on both sides. Candidates within 1e-9 of the k-th by matrix
product are scored again one after the other in double precision; ties go to smaller ids.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of different lengths are
not compared: each length is a search of its own. Vectors are scaled by powers of two before they are squared, so very small and very
large ones have true cosines. Equal vectors are each a candidate. A query with fewer candidates than k gets all of its visited
ones; an empty table gives an empty result. Ids must be integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.llm import text_arrays as A
from sonoframe.llm.staging import ship, staged


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component is near one: no rounding, and squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q with each row, every sum taken from left to right."""
    total = lambda p: np.cumsum(p, axis=1)[:, -1]
    q, x = scaled(q[None, :])[0], scaled(x)
    return total(x * q) / (np.sqrt(total((q * q)[None, :])) * np.sqrt(total(x * x)))


class KMeansTree:
    """Nodes in arrays: centroids, first child and number of children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, n_leaves: int, branch: int = 8, rounds: int = 8, seed: int = 1):
        self.centroids, self.children, self.leaf = [np.zeros(sample.shape[1])], [()], [-1]
        rng = np.random.default_rng(seed)
        heap = [(-len(sample), 0, np.arange(len(sample)))]
        count = 1
        while heap and count < n_leaves:  # the fullest node is split first
            size, node, rows = heapq.heappop(heap)
            k = min(branch, n_leaves - count + 1)
            centres, label = self._split(sample[rows], k, rounds, rng)
            if len(centres) < 2:
                continue
            first = len(self.centroids)
            self.children[node] = tuple(range(first, first + len(centres)))
            for j, c in enumerate(centres):
                self.centroids.append(c)
                self.children.append(())
                self.leaf.append(-1)
                heapq.heappush(heap, (-int((label == j).sum()), first + j, rows[label == j]))
            count += len(centres) - 1
        self.centroids = np.array(self.centroids)
        leaves = [i for i, c in enumerate(self.children) if not c]
        for number, i in enumerate(leaves):
            self.leaf[i] = number
        self.n_leaves = len(leaves)

    @staticmethod
    def _split(x: np.ndarray, k: int, rounds: int, rng) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.unique(x, axis=0)
        if len(distinct) < 2:
            return distinct, np.zeros(len(x), int)
        centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(rounds):
            label = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, x)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
        label = (x @ centres.T).argmax(axis=1)
        used = np.unique(label)
        return centres[used], np.searchsorted(used, label)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at each node."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                children = np.array(self.children[node])
                pick = (x[rows] @ self.centroids[children].T).argmax(axis=1)
                todo += [(c, rows[pick == j]) for j, c in enumerate(children)]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which a best-bin-first search visits them."""
        nearness = self.centroids @ q
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            for c in self.children[node]:
                heapq.heappush(queue, (-nearness[c], c))


#: sampled vectors that a leaf needs
SAMPLE = 32


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.99, sample_rows: int = 1 << 17, leaf_rows: int | None = None, bin_rows: int = 2048, query_rows: int = 512, calibration: int = 64, seed: int = 19, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the search finds for each row where is_query (of id_col) holds.

    leaf_rows: vectors of a leaf, the root of their number if it is None.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():  # one row a length
        if length["count"] > 1:
            own = rows.filter(F.size("v") == length["n"])
            out = out.unionByName(_nearest(own, length["count"], is_query, k, recall, sample_rows, leaf_rows, bin_rows, query_rows, calibration, seed))
    return out


def _nearest(rows: DataFrame, total: int, is_query: Column, k: int, recall: float, sample_rows: int, leaf_rows: int | None, bin_rows: int, query_rows: int, calibration: int, seed: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    n_leaves = max(1, min(-(-total // (leaf_rows or max(1, math.isqrt(total)))), sample_rows // SAMPLE))
    wanted = min(total, n_leaves * SAMPLE)
    seeded, turns = F.xxhash64("vec_id", F.lit(seed)), 1 << 30
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(turns)) < -(-turns * wanted // total)).select("v").limit(wanted * 2)  # the limit is for tables of repeated rows
    sample = matrix(sample.toArrow()["v"])
    tree = KMeansTree(unit(sample), n_leaves) if len(sample) else KMeansTree(np.ones((1, 1)), 1)
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.assign(unit(matrix(batch["v"]))) if len(batch) else np.zeros(0, np.int32)
            yield batch.append_column("leaf", pa.array(leaf, pa.int32()))

    kind = rows.schema["v"].dataType.simpleString()
    index = staged(rows.mapInArrow(place, f"vec_id long, v {kind}, leaf int"), "ann-index")
    counts = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row a leaf
    queries = index.filter(is_query).select("vec_id", "v")
    visits = _calibrate(index, queries.orderBy(seeded, "vec_id").limit(calibration).distinct(), tree, k, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for q in unit(matrix(batch["v"])) if len(batch) else ():
                goes, seen = [], 0
                for leaf in sent.value.best_first(q):
                    if len(goes) >= visits and seen > k:
                        break
                    seen += counts.get(leaf, 0)
                    goes.append(leaf)
                lists.append(goes)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "q", "leaves"])

    asked = staged(queries.mapInArrow(walk, f"query_id long, q {kind}, leaves array<int>"), "ann-asked")
    asks = {r.leaf: r["count"] for r in asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}  # one row a leaf
    bins = spark.sparkContext.broadcast(Bins(tree.n_leaves, counts, asks, bin_rows, query_rows))

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bins.value
        for batch in batches:
            leaf = batch["leaf"].to_numpy()
            at = b.first[leaf] + (_spread(batch["vec_id"].to_numpy()) + np.arange(len(leaf), dtype=np.uint64)) % b.several[leaf].astype(np.uint64)
            copies = b.copies[at.astype(np.int64)]
            row = np.repeat(np.arange(len(leaf)), copies)
            part = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield batch.take(pa.array(row)).append_column("bin", pa.array(at.astype(np.int32)[row])).append_column("part", pa.array(part, pa.int32()))

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bins.value
        for batch in batches:
            row, where, leaves = [], [], []
            for i, own in enumerate(batch["leaves"].to_pylist()):
                goes: dict[int, list[int]] = {}
                for leaf in own:
                    for at in range(b.first[leaf], b.first[leaf] + b.several[leaf]):
                        goes.setdefault(at, []).append(leaf)
                row += [i] * len(goes)
                where += goes
                leaves += goes.values()
            row = np.array(row, np.int64)
            part = _spread(batch["query_id"].to_numpy()[row]) % b.copies[where].astype(np.uint64)
            taken = batch.select(["query_id", "q"]).take(pa.array(row))
            for name, column in (("bin", pa.array(where, pa.int32())), ("part", pa.array(part.astype(np.int32))), ("leaves", pa.array(leaves, pa.list_(pa.int32())))):
                taken = taken.append_column(name, column)
            yield taken

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = _search(own, asked, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    own = index.mapInArrow(deal_rows, f"vec_id long, v {kind}, leaf int, bin int, part int").groupBy("bin", "part")
    theirs = asked.mapInArrow(deal_queries, f"query_id long, q {kind}, bin int, part int, leaves array<int>").groupBy("bin", "part")
    best = own.cogroup(theirs).applyInArrow(search, "query_id long, vec_id long, score double")
    return _top(best, k).select("query_id", "rank", "vec_id", "score")


class Bins:
    """first bin and number of bins of each leaf; copies of each bin."""

    def __init__(self, n_leaves: int, rows: dict[int, int], asks: dict[int, int], bin_rows: int, query_rows: int):
        self.first, self.several = np.zeros(n_leaves, np.int64), np.ones(n_leaves, np.int64)
        asked: list[int] = []
        filled = bin_rows
        for leaf in range(n_leaves):  # leaves in order fill bins; a large leaf has bins of its own
            c, a = rows.get(leaf, 0), asks.get(leaf, 0)
            if c > bin_rows:
                self.first[leaf], self.several[leaf] = len(asked), -(-c // bin_rows)
                asked += [a] * int(self.several[leaf])
                filled = bin_rows
                continue
            if filled + c > bin_rows or not asked:
                asked.append(0)
                filled = 0
            self.first[leaf] = len(asked) - 1
            asked[-1] += a
            filled += c
        self.copies = np.maximum(1, -(-np.array(asked, np.int64) // query_rows))


def _spread(ids: np.ndarray) -> np.ndarray:
    return A.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)


def _top(best: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(own: pa.Table, asked: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best rows of its leaves in this bin."""
    none = np.zeros(0)
    if not len(own) or not len(asked):
        return none, none, none
    x, ids, leaf = matrix(own["v"]), own["vec_id"].to_numpy(), own["leaf"].to_numpy()
    q, qid = matrix(asked["q"]), asked["query_id"].to_numpy()
    leaves = asked["leaves"].to_pylist() if "leaves" in asked.column_names else None
    lengthless = unit(x)
    found: list[tuple] = []
    for lo in range(0, len(q), 256):
        near = unit(q[lo : lo + 256]) @ lengthless.T
        for i, row in enumerate(near):
            ok = ids != qid[lo + i]
            if leaves is not None:
                ok &= np.isin(leaf, leaves[lo + i])
            at = np.flatnonzero(ok)
            if len(at) > k:
                at = at[row[at] >= np.partition(row[at], -k)[-k] - 1e-9]
            if not len(at):
                continue
            score = cosines(q[lo + i], x[at])
            order = np.lexsort((ids[at], -score))[:k]
            found.append((np.full(len(order), qid[lo + i]), ids[at][order], score[order]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none)


def _calibrate(index: DataFrame, queries: DataFrame, tree: KMeansTree, k: int, recall: float) -> int:
    """The fewest leaf visits that reach `recall` of the true neighbours of a bounded set of queries."""
    asked = queries.toArrow()
    if tree.n_leaves == 1 or not len(asked):
        return tree.n_leaves
    asked = asked.rename_columns(["query_id", "q"])
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.Table.from_batches([batch])
            qid, ids, score = _search(own, sent.value, k)
            leaf = dict(zip(batch["vec_id"].to_pylist(), batch["leaf"].to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array([leaf[int(i)] for i in ids], pa.int32())], names=["query_id", "vec_id", "score", "leaf"])

    true = _top(index.mapInArrow(brute, "query_id long, vec_id long, score double, leaf int"), k).collect()
    q = dict(zip(asked["query_id"].to_pylist(), unit(matrix(asked["q"])), strict=True))
    visit = {i: {leaf: n for n, leaf in enumerate(tree.best_first(x))} for i, x in q.items()}
    needed = np.sort([visit[r.query_id][r.leaf] + 1 for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else tree.n_leaves
