"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles; documents are linked where the sets' Jaccard similarity reaches the threshold.

1. Features. Sets are hashed (64 bits a shingle). A set's identity is its size and two 64-bit sums; its
   sketch is 64 minwise values. Documents of equal sets are one class from here on.
2. Trees. In each of `trees` trees a node branches its documents by two minwise tokens: a similar pair stays
   together in a branch with its similarity as probability. Roots have tokens of their own, other nodes take two
   of their level's pool by a hash of the node, so branches of a document live or die by different tokens. A node of at most
   `limit` documents is compared exhaustively on sketches (31 of 64 values) and not branched again.
   A larger node first meets a few pivots of its own: who has 24 of 64 values of a pivot's sketch is joined with it, and who
   has 48 does not branch on, for the pivot stands for it. So a group of near copies, whatever its size, shrinks at each level and
   is never compared in pairs. The rest branches, `levels` deep at most; what is still large then is taken as one cluster uncompared.
   A pair at 0.75 whose nodes are all large is missed four levels deep with probability 0.110 in one tree and
   1.0e-5 in six, which share the pools (0.106 and 1.4e-6 if all tokens were independent); the sketch filter misses it
   with about 2e-7. If a pivot stands for one of the two, the other must have 24 values of that pivot: at a similarity of 0.6 it has
   not with 1e-4, at 0.5 (the least that 0.75 twice over allows) with 0.03.
3. Clusters. The components of what the trees found are clusters; all links lie within them. Large clusters are cut into
   blocks of bounded size. Each document's text is sent once to its block, and there also goes the cluster's first document.
   Sets are rebuilt and all intersections in a block counted by matrix products. Most clusters are one component then.
   Where one is not, only documents outside its largest component are sent to the other blocks: a cluster of n near copies
   costs n texts and not n squared, whatever n.
4. Components of the exact links, joined back to all documents by set identity.

Ids must be integers; others stop the job. Nulls: a null or wordless text has no shingles and is linked with nothing; a null id is
returned unlinked and kept. With fewer words than a shingle the whole sequence is the one shingle. Rows of one id are one vertex.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm import text_arrays as A
from sonoframe.llm.components import components
from sonoframe.llm.staging import partitions, ship, staged, writers

SKETCH = 64
#: fewest equal sketch values of 64 for a pair that may be linked
ALIKE = 31
#: equal values with a pivot of a large node: for being joined with it, and for being stood for by it
NEAR_PIVOT, AT_PIVOT = 24, 48
#: pivots that a large node draws at each level
PIVOTS = 4
#: first and end sketch value of the root tokens and of the pools of the levels below
_POOLS = ((0, 12), (12, 32), (32, 50), (50, 64))
_ODD = A.mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column, n: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, sorted distinct shingle hashes one row after the other, and their offsets."""
    data, offsets = A.buffers(column)
    for lo, hi in A.pieces(offsets):
        own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end, count = A.words(own, off)
        hashes = A.word_hashes(own, start, end, lower=True)
        first = np.cumsum(count) - count
        many = np.maximum(count - n + 1, (count > 0).astype(np.int64))
        to = np.concatenate([[0], np.cumsum(many)])
        values = np.empty(to[-1], np.uint64)
        window = A.window_hashes(hashes, n)
        long = count >= n
        at = np.repeat(first[long] - to[:-1][long], many[long]) + np.flatnonzero(np.repeat(long, many))
        values[np.repeat(long, many)] = window[at]
        for m in range(1, n):
            if (short := np.flatnonzero(count == m)).size:
                values[to[short]] = A.window_hashes(hashes, m)[first[short]]
        for i in range(hi - lo):
            values[to[i] : to[i + 1]].sort()
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[to[:-1][many > 0]] = True
        yield lo, values[new], np.concatenate([[0], np.cumsum(new)])[to]


def _identity(values: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; 0 for empty ones."""
    out = np.zeros((2, len(to) - 1), np.uint64)
    full = np.diff(to) > 0
    if full.any():
        out[0][full] = np.add.reduceat(A.mix(values), to[:-1][full])
        out[1][full] = np.add.reduceat(A.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), to[:-1][full])
    return out[0].view(np.int64), out[1].view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sketch) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, to in shingle_sets(batch[text_col], shingle):
                n = len(to) - 1
                full = np.diff(to) > 0
                sketch = np.zeros((n, SKETCH), np.uint32)
                if full.any():
                    for k in range(SKETCH):
                        sketch[full, k] = np.minimum.reduceat(values * _ODD[k], to[:-1][full]) >> np.uint64(32)
                s1, s2 = _identity(values, to)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * SKETCH * 4, SKETCH * 4, dtype=np.int32)), pa.py_buffer(sketch)])
                yield pa.RecordBatch.from_arrays([batch[id_col].slice(lo, n).cast(pa.int64()), pa.array(np.diff(to)), pa.array(s1), pa.array(s2), raw], names=["doc_id", "n_shingles", "s1", "s2", "sketch"])

    return docs.select(id_col, text_col).mapInArrow(A.trimmed(make), "doc_id long, n_shingles long, s1 long, s2 long, sketch binary")


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """Lists of whole keys from batches sorted by key; what may go on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        if held and held[-1][key][-1].as_py() == keys[0] == keys[-1]:
            held.append(batch)
            continue
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        whole = [*held, batch.slice(0, cut)] if cut else held
        if whole:
            yield whole
        held = [batch.slice(cut)]
    if held:
        yield held


def _labels(linked: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a symmetric adjacency matrix."""
    n = len(linked)
    label = np.arange(n)
    linked = linked | np.eye(n, dtype=bool)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _forest(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each component's members to its first."""
    label = _labels(linked)
    out = np.flatnonzero(label != np.arange(len(label)))
    return ids[out], ids[label[out]]


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare_nodes(threshold: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _by_key(batches, "node"):
            part = pa.Table.from_batches(whole).combine_chunks()
            node, rep, size = (part[c].to_numpy() for c in ("node", "rep", "n_shingles"))
            sketch = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint32).reshape(-1, SKETCH).astype(np.uint16)
            begin = run_starts(node)
            count = np.diff(np.append(begin, len(node)))
            two = begin[count == 2]
            same = (sketch[two] == sketch[two + 1]).sum(axis=1) >= ALIKE
            same &= 100 * np.minimum(size[two], size[two + 1]) >= threshold * np.maximum(size[two], size[two + 1])
            found = [(rep[two[same]], rep[two[same] + 1])]
            for i, m in zip(begin[count > 2], count[count > 2], strict=True):
                own, n = sketch[i : i + m], size[i : i + m]
                linked = np.concatenate([(own[k : k + 64, None, :] == own[None, :, :]).sum(axis=2, dtype=np.uint8) for k in range(0, m, 64)]) >= ALIKE
                linked &= 100 * np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
                found.append(_forest(rep[i : i + m], linked))
            yield _edges(found)

    return compare


def run_starts(key: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new)


def exact_links(sets: list[np.ndarray], threshold: int, width: int = 8192) -> np.ndarray:
    """Matrix of 100 * intersection >= threshold * union, by products of incidence matrices."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    value, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    begin = run_starts(value)
    count = np.diff(np.append(begin, len(value)))
    shared = np.repeat(count > 1, count)
    column, row = np.repeat(np.cumsum(count > 1) - 1, count)[shared], row[shared]
    both = np.zeros((m, m), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if j > i:
            x = np.zeros((m, int(column[j - 1]) - k * width + 1), np.float32)
            x[row[i:j], column[i:j] - k * width] = 1
            both += x @ x.T
    both = both.astype(np.int64)
    union = size[:, None] + size[None, :] - both
    return (100 * both >= threshold * union) & (size[:, None] > 0) & (size[None, :] > 0)


def _compare_tiles(threshold: int, shingle: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _by_key(batches, "tile"):
            part = pa.Table.from_batches(whole).combine_chunks()
            tile, doc, side, s1, s2 = (part[c].to_numpy() for c in ("tile", "doc_id", "side", "s1", "s2"))
            sets: list[np.ndarray] = []
            right = np.zeros(len(part), bool)
            for lo, values, to in shingle_sets(part["text"], shingle):
                a, b = _identity(values, to)
                right[lo : lo + len(a)] = (a == s1[lo : lo + len(a)]) & (b == s2[lo : lo + len(a)])
                sets += np.split(values, to[1:-1])
            begin = run_starts(tile)
            found = []
            for i, j in zip(begin, np.append(begin[1:], len(tile)), strict=True):
                own = np.flatnonzero(right[i:j]) + i
                if len(own) < 2:
                    continue
                linked = exact_links([sets[k] for k in own], threshold)
                if side[own].any():  # pairs of a block have been compared
                    linked &= side[own][:, None] != side[own][None, :]
                found.append(_forest(doc[own], linked))
            yield _edges(found)

    return compare


def near_duplicates(docs: DataFrame, threshold: int = 75, shingle: int = 5, trees: int = 6, levels: int = 4, limit: int = 64, block_docs: int = 128, block_shingles: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; threshold in percent."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    base = staged(features(docs, id_col, text_col, shingle), "near-features")
    classes = base.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = staged(classes, "near-classes")
    clusters = staged(components(_candidates(classes, threshold, trees, levels, limit, n), "near-alike"), "near-clusters")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    links = _confirm(own, classes, clusters, threshold, shingle, block_docs, block_shingles, n)
    linked = links.withColumnsRenamed({"v": "rep", "c": "component"})
    groups = classes.select("n_shingles", "s1", "s2", "rep").join(linked, "rep", "left").select("n_shingles", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = base.select("doc_id", "n_shingles", "s1", "s2").join(groups, ["n_shingles", "s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _candidates(classes: DataFrame, threshold: int, trees: int, levels: int, limit: int, n: int) -> DataFrame:
    """Edges (a, b) of pairs that may be linked. Sizes and pivots are written tables, so the joins of nodes that hold many documents
    are joins of two plain exchanges, which Spark splits where one key is large."""
    sketches = classes.select("rep", "n_shingles", "sketch")
    found: list[DataFrame] = []
    small: list[DataFrame] = []
    few = writers(classes.sparkSession)
    nodes = staged(_branch(classes, trees, 0), "near-nodes")
    for level in range(levels):
        turned = F.lit(int(_ODD[level].view(np.int64)))  # another order of ids at each level, as plain longs
        pivots = [F.min(F.when(F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(PIVOTS)) == k, F.col("rep").bitwiseXOR(turned))).bitwiseXOR(turned).alias(f"p{k}") for k in range(PIVOTS)]
        sizes = staged(nodes.groupBy("node").agg(F.count("*").alias("size"), *pivots).coalesce(few), "near-sizes")
        # each row finds its node's one size, single ones too: as many rows as before, whatever the nodes hold
        sized = staged(nodes.join(sizes.select("node", "size"), "node"), "near-sized")
        small.append(sized.filter((F.col("size") > 1) & (F.col("size") <= limit)).select("node", "rep"))
        large = sizes.filter(F.col("size") > limit)
        if large.isEmpty():
            break
        if level + 1 == levels:
            found.append(sized.join(large.select("node", F.coalesce(*[f"p{k}" for k in range(PIVOTS)]).alias("b")), "node").select(F.col("rep").alias("a"), "b"))
            break
        pivot_of = large.select("node", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("rep")).filter("rep IS NOT NULL").join(sketches.select("rep", "sketch"), "rep")
        pivot_of = staged(pivot_of.groupBy("node").agg(F.collect_list(F.struct("rep", "sketch")).alias("pivots")).coalesce(few), "near-pivots")  # PIVOTS of a node at most
        held = sized.filter(F.col("size") > limit).drop("size").join(pivot_of, "node").join(sketches.select("rep", "sketch"), "rep")
        step = staged(_branch(held, trees, level + 1), "near-nodes")
        found.append(step.filter("node IS NULL").select("rep", "pivot"))
        nodes = step.filter("node IS NOT NULL").select("tree", "node", "rep")
    # small nodes of all levels are compared together: their names are 64-bit hashes of the way down to them
    whole = reduce(DataFrame.union, small).join(sketches, "rep").repartition(n, "node").sortWithinPartitions("node")
    alike = staged(whole.mapInArrow(A.trimmed(_compare_nodes(threshold)), "a long, b long"), "near-pairs")
    alike = reduce(DataFrame.union, found, alike)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _edges([spanning(batch["a"].to_numpy(), batch["b"].to_numpy())])

    # trees find the same pairs again and again: what a batch has twice need not go into the components
    return alike.coalesce(max(1, n // 8)).mapInArrow(A.trimmed(forest), "a long, b long")


def _tokens_of(above: np.ndarray | np.uint64, tree: int, level: int, r: int):
    """Number of the r-th of the two sketch values by which nodes branch."""
    lo, end = _POOLS[1 + (level - 1) % (len(_POOLS) - 1) if level else 0]
    if not level:
        return lo + (tree * 2 + r) % (end - lo)
    h = A.mix(above ^ np.uint64(0x5BD1E995))
    first, step = h % np.uint64(end - lo), np.uint64(1) + (h >> np.uint64(32)) % np.uint64(end - lo - 1)
    return lo + ((first + np.uint64(r) * step) % np.uint64(end - lo)).astype(np.int64)


def _branch(rows: DataFrame, trees: int, level: int) -> DataFrame:
    """(tree, node, rep, pivot): each document in the two children that its tokens choose; at the root, in each tree.

    Below the root, rows carry their node's pivots. Documents alike to one give a row (rep, pivot) without node, those at
    one do not branch on.
    """

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint32).reshape(-1, SKETCH)
            rep, on = batch["rep"].to_numpy(), np.ones(len(batch), bool)
            if "pivots" in batch.schema.names and len(batch):
                a, b, at = _meet_pivots(batch, token, rep)
                on[at] = False
                yield _node_rows(0, None, a, b)
            token = token.astype(np.uint64)
            for tree in range(trees):
                own = np.flatnonzero(on & (batch["tree"].to_numpy() == tree)) if level else np.arange(len(rep))
                above = batch["node"].to_numpy()[own].view(np.uint64) if level else np.uint64(tree + 1)
                for r in range(2):
                    f = _tokens_of(above, tree, level, r)
                    node = A.mix(A.mix(token[own, f] + (np.asarray(f, np.uint64) << np.uint64(32))) ^ above).view(np.int64)
                    if len(own):
                        yield _node_rows(tree, node, rep[own], None)

    return rows.mapInArrow(A.trimmed(branch), "tree int, node long, rep long, pivot long")


def _node_rows(tree: int, node: np.ndarray | None, rep: np.ndarray, pivot: np.ndarray | None) -> pa.RecordBatch:
    column = lambda x: pa.nulls(len(rep), pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rep), tree, np.int32)), column(node), column(rep), column(pivot)], names=["tree", "node", "rep", "pivot"])


def _meet_pivots(batch: pa.RecordBatch, token: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the edges between documents and pivots alike to them, and which rows a pivot stands for."""
    lists = batch["pivots"]
    begin = lists.offsets.to_numpy()
    first, many = begin[:-1], np.diff(begin)
    flat = lists.values
    ids = flat.field("rep").to_numpy()
    sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
    a, b, stood = [], [], np.zeros(len(rep), bool)
    for k in range(int(many.max())):
        row = np.flatnonzero(many > k)
        pivot = ids[first[row] + k]
        same = (token[row] == sketch[first[row] + k]).sum(axis=1)
        same[pivot == rep[row]] = 0  # a pivot itself branches on
        stood[row[same >= AT_PIVOT]] = True
        near = same >= NEAR_PIVOT
        a.append(rep[row[near]])
        b.append(pivot[near])
    a, b = spanning(np.concatenate(a), np.concatenate(b))
    return a, b, np.flatnonzero(stood)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex of the edges (a, b) to the smallest that it reaches."""
    vertex, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, left, right = np.arange(len(vertex)), place[: len(a)], place[len(a) :]
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            break
    out = np.flatnonzero(label != np.arange(len(label)))
    return vertex[out], vertex[label[out]]


def _confirm(docs: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: int, shingle: int, block_docs: int, block_shingles: int, n: int) -> DataFrame:
    """(v, c): components of the exact links within clusters."""
    compare = lambda sent: sent.repartition(n, "tile").sortWithinPartitions("tile", "last").mapInArrow(A.trimmed(_compare_tiles(threshold, shingle)), "a long, b long")
    members = staged(classes.select("rep", "n_shingles", "s1", "s2").join(clusters.withColumnsRenamed({"v": "rep", "c": "cluster"}), "rep"), "near-members")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("blocks"))
    sizes = staged(sizes.filter("blocks > 1"), "near-blocks")
    members = members.join(sizes, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep", "s1"), F.col("blocks")).cast("int")).drop("n_shingles")
    texts = staged(docs.join(members.withColumnRenamed("rep", "doc_id"), "doc_id"), "near-texts")  # all texts are exchanged here, once; those of clusters go on
    first = F.col("doc_id") == F.col("cluster")
    places = texts.withColumn("at", F.explode(F.when(first, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    places = places.select(F.xxhash64("cluster", "at").alias("tile"), (F.col("at") != F.col("block")).alias("last"), F.lit(0).alias("side"), "doc_id", "s1", "s2", "text")
    links = staged(compare(places), "near-links")
    linked = components(links, "near-linked")
    if sizes.isEmpty():
        return linked
    # clusters of several blocks that are not one component yet: who is outside the largest goes to all blocks
    linked = staged(linked, "near-linked")
    apart = members.filter("blocks > 1").join(linked.withColumnsRenamed({"v": "rep", "c": "component"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = staged(apart.select("rep", "cluster", "component"), "near-apart")
    parts = apart.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("core"), (F.sum("count") - F.max("count")).alias("outside"))
    parts = staged(parts.filter("outside > 0").withColumn("groups", F.ceil(F.col("outside") / block_docs).cast("int")), "near-outside")
    if parts.isEmpty():
        return linked
    rest = texts.join(apart.join(parts, "cluster").select(F.col("rep").alias("doc_id"), "component", "core", "groups"), "doc_id")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    here = rest.select("*", all_of("groups").alias("group"), F.col("block").alias("at"), F.lit(0).alias("side"))
    there = rest.filter("component <> core").select("*", F.pmod(F.xxhash64("doc_id", "s2"), F.col("groups")).cast("int").alias("group"), all_of("blocks").alias("at"), F.lit(1).alias("side"))
    more = compare(here.unionByName(there).select(F.xxhash64("cluster", "at", "group").alias("tile"), F.lit(False).alias("last"), "side", "doc_id", "s1", "s2", "text"))
    return components(more.union(linked.select("v", "c")), "near-linked")
