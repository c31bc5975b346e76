"""Removal of long passages that an earlier document has, by fixed-block anchors.

A passage is a run of `window` words. Any run of that length covers a whole block of `block` = (window + 1) // 2
words aligned in its own document, so it is enough to index non-overlapping blocks and to probe them with every
rolling window of `block` words. Around each hit the repeat is extended: all windows of `window` words that
contain it are fingerprinted (104 bits) on both sides, and a window goes where the smallest document that
has it is smaller than its own. Adjoining windows that go make up the maximal exact repeats.

Documents are dealt by id into chunks of at most about chunk_bytes of text, at least as many as the session has shuffle partitions, so a
task's memory does not follow the table. Chunks exchange never single words or pairs: a chunk sends each bucket of the fingerprint space one packed row (sorted unique values, so a passage
that a third of all documents share is one value per chunk), and gets one packed row back.
Three such passes read the texts of a chunk: blocks and probes; windows around hits; removal.

Nulls: a null text has no words; a document whose id is null is returned unchanged and takes no part. Rows of
the same id never remove from each other. Ids must be integers; others stop the job. Empty texts and tables give empty results; a very long text needs
memory in proportion to itself. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import text_arrays as A
from sonoframe.llm.staging import apart, partitions, ship

_BITS = np.uint64(40)
_MASK = np.uint64((1 << 40) - 1)
_REST = np.uint64(24)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that Spark's hash partitioning deals to n different partitions."""
    found = spark.range(40 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    return sorted(r.k for r in found.collect())  # at most n rows


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """The low `width` bytes of 64-bit values, all first bytes, then all second ones: high bytes that are alike compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int = 8) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(width, -1)
    values = np.zeros((own.shape[1], 8), np.uint8)
    values[:, :width] = own.T
    return values.view(np.uint64).ravel()


def pack(values: np.ndarray, width: int = 8) -> bytes:
    """Sorted values as planes of their differences."""
    return planes(np.diff(values, prepend=np.zeros(1, np.uint64)), width)


def unpack(raw: bytes, width: int = 8) -> np.ndarray:
    return np.cumsum(unplanes(raw, width), dtype=np.uint64)


def _fingerprints(group: pa.Table, text_col: str, sizes: list[tuple[int, bool]]):
    """For runs of rows: first row, words of each, and for each (size, second) the hashes of windows, with row and place."""
    data, offsets = A.buffers(group[text_col])
    for lo, hi in A.pieces(offsets):
        own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end, count = A.words(own, off)
        hashes = A.word_hashes(own, start, end)
        row = np.repeat(np.arange(lo, hi), count)
        first = np.cumsum(count) - count
        place = np.arange(len(row)) - first[row - lo]
        made = []
        for n, second in sizes:
            value = A.window_hashes(hashes, n, second)
            whole = row[: len(value)] == row[n - 1 : n - 1 + len(value)]
            made.append((value, whole))
        yield lo, count, row, place, made


def _members(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == values


def _bucketed(value: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket above, 40 bits of the hash below."""
    return ((value >> _BITS) % np.uint64(n_buckets)) << _BITS | value & _MASK


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def remove_repeats(docs: DataFrame, window: int = 50, chunk_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay, joined by one space)."""
    return apart(docs, [id_col, text_col], ["n_words", "n_removed", "kept"], lambda own: _remove_repeats(own, window, chunk_bytes, id_col, text_col))


def _remove_repeats(docs: DataFrame, window: int, chunk_bytes: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    n = max(partitions(spark), math.ceil((docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) / chunk_bytes))
    block = (window + 1) // 2
    results = ["n_words", "n_removed", "kept"]
    columns = [c for c in docs.columns if c.lower() not in results]
    chunks = F.array(*[F.lit(k) for k in even_keys(spark, n)])
    chunk = F.element_at(chunks, (F.pmod(F.xxhash64(F.col(id_col), F.lit("chunk")), F.size(chunks)) + 1).cast("int"))
    dealt = docs.select(*[F.col(f"`{c}`") for c in columns], chunk.alias("_chunk")).repartition(n, "_chunk")

    def ids(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        column = group[id_col].combine_chunks()
        return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)

    def ask_blocks(group: pa.Table) -> pa.Table:
        doc, valid = ids(group)
        keys, owners, refs = [], [], []
        for _, _, row, place, [(value, whole)] in _fingerprints(group, text_col, [(block, False)]):
            whole &= valid[row[: len(value)]]
            keys.append(_bucketed(value[whole], n))
            owners.append(doc[row[: len(value)][whole]])
            refs.append(place[: len(value)][whole] % block == 0)
        key, owner, ref = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (owners, np.int64), (refs, bool)))
        order = np.argsort(key, kind="stable")
        key, owner, ref = key[order], owner[order], ref[order]
        begin = _runs(key)
        flags = np.zeros(len(begin), np.uint8)
        if len(begin):
            flags |= np.logical_or.reduceat(ref, begin).astype(np.uint8)
            flags |= (np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)).astype(np.uint8) << 1
        unique = key[begin]
        cut = np.flatnonzero(np.diff(unique >> _BITS)) + 1
        out = [(int(u[0] >> _BITS), group["_chunk"][0].as_py(), pack(u & _MASK, 5), f.tobytes()) for u, f in zip(np.split(unique, cut), np.split(flags, cut), strict=True) if len(u)]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "chunk": pa.array([x[1] for x in out], pa.int32()), "keys": pa.array([x[2] for x in out], pa.binary()), "flags": pa.array([x[3] for x in out], pa.binary())})

    def answer_blocks(group: pa.Table) -> pa.Table:
        """Blocks that two documents have, at least one of them as a block of its own."""
        parts = [unpack(x.as_py(), 5) for x in group["keys"]]
        flags = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in group["flags"]])
        key = np.concatenate(parts)
        order = np.argsort(key, kind="stable")
        begin = _runs(key[order])
        count = np.diff(np.append(begin, len(key)))
        seen = np.bitwise_or.reduceat(flags[order], begin)
        live = np.empty(len(key), bool)
        live[order] = np.repeat((seen & 1 > 0) & ((seen & 2 > 0) | (count > 1)), count)
        kept = [p[m] for p, m in zip(parts, np.split(live, np.cumsum([len(p) for p in parts])[:-1]), strict=True)]
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "keys": pa.array([pack(x, 5) for x in kept], pa.binary())})

    def ask_windows(group: pa.Table, hits: pa.Table) -> pa.Table:
        doc, valid = ids(group)
        live = [unpack(k.as_py(), 5) | np.uint64(b.as_py()) << _BITS for b, k in zip(hits["bucket"], hits["keys"], strict=True)]
        live = np.sort(np.concatenate(live)) if live else np.zeros(0, np.uint64)
        found = []
        for _, _, row, _, [(value, whole), (a, fits), (b, _)] in _fingerprints(group, text_col, [(block, False), (window, False), (window, True)]) if len(live) else ():
            hit = _members(live, _bucketed(value, n)) & whole & valid[row[: len(value)]]
            near = np.concatenate([[0], np.cumsum(hit)])  # hits among the blocks that a window contains
            at = np.flatnonzero(fits)
            at = at[near[at + window - block + 1] > near[at]]
            found.append((a[at], b[at] >> _REST, doc[row[at]]))
        a, b, owner = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
        bucket = (a >> _BITS) % np.uint64(n)
        order = np.lexsort((owner, b, a, bucket))
        a, b, owner, bucket = a[order], b[order], owner[order], bucket[order]
        begin = _runs(a, b)
        several = np.maximum.reduceat(owner, begin) != owner[begin] if len(begin) else np.zeros(0, bool)
        a, b, owner, bucket = a[begin], b[begin], owner[begin], bucket[begin]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        out = [(int(k[0]), group["_chunk"][0].as_py(), pack(x), planes(y, 5), planes(d), s.tobytes()) for k, x, y, d, s in zip(*(np.split(c, cut) for c in (bucket, a, b, owner, several)), strict=True) if len(k)]
        names = {"bucket": pa.int32(), "chunk": pa.int32(), "a": pa.binary(), "b": pa.binary(), "doc": pa.binary(), "several": pa.binary()}
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(names.items())})

    def answer_windows(group: pa.Table) -> pa.Table:
        """For each window that several documents have, the smallest of them."""
        parts = [unpack(x.as_py()) for x in group["a"]]
        a = np.concatenate(parts)
        b = np.concatenate([unplanes(x.as_py(), 5) for x in group["b"]])
        doc = np.concatenate([unplanes(x.as_py()).view(np.int64) for x in group["doc"]])
        several = np.concatenate([np.frombuffer(x.as_py(), bool) for x in group["several"]])
        order = np.lexsort((doc, b, a))
        begin = _runs(a[order], b[order])
        count = np.diff(np.append(begin, len(a)))
        shared, least = np.empty(len(a), bool), np.empty(len(a), np.int64)
        shared[order] = np.repeat(np.logical_or.reduceat(several[order], begin) | (count > 1), count)
        least[order] = np.repeat(doc[order][begin], count)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        cut = [np.split(x, ends) for x in (a, b, least, shared)]
        return pa.table({"chunk": group["chunk"], **{k: pa.array([f(x[m]) for x, m in zip(cut[i], cut[3], strict=True)], pa.binary()) for i, (k, f) in enumerate((("a", pack), ("b", lambda x: planes(x, 5)), ("least", planes)))}})

    out_schema = T.StructType([docs.schema[c] for c in columns]).add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def remove(group: pa.Table, answers: pa.Table) -> pa.Table:
        doc, valid = ids(group)
        a, b, least = (np.concatenate([f(x.as_py()) for x in answers[c]]) if len(answers) else np.zeros(0, np.uint64) for c, f in (("a", unpack), ("b", lambda x: unplanes(x, 5)), ("least", lambda x: unplanes(x).view(np.int64))))
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        n_words, n_removed = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        data, offsets = A.buffers(group[text_col])
        gone_of: dict[int, np.ndarray] = {}
        for lo, count, row, _, [(x, fits), (y, _)] in _fingerprints(group, text_col, [(window, False), (window, True)]):
            n_words[lo : lo + len(count)] = count
            at = np.flatnonzero(_members(a, x) & fits & valid[row[: len(x)]])
            where = np.searchsorted(a, x[at])
            goes = np.zeros(len(at), bool)
            open_ = np.arange(len(at))
            while len(open_):  # one step, unless two windows share the first 64 bits
                w = where[open_]
                same = a[np.minimum(w, len(a) - 1)] == x[at[open_]]
                open_, w = open_[same & (w < len(a))], w[same & (w < len(a))]
                match = b[w] == y[at[open_]] >> _REST
                goes[open_[match]] = least[w[match]] < doc[row[at[open_[match]]]]
                open_ = open_[~match]
                where[open_] += 1
            step = np.zeros(len(row) + 1, np.int64)
            np.add.at(step, at[goes], 1)
            np.add.at(step, at[goes] + window, -1)
            gone = np.cumsum(step)[:-1] > 0
            removed = np.bincount(row[gone] - lo, minlength=len(count))
            n_removed[lo : lo + len(count)] = removed
            first = np.cumsum(count) - count
            gone_of.update({lo + i: gone[first[i] : first[i] + count[i]] for i in np.flatnonzero(removed)})
        kept = []
        for i in range(len(group)):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            kept.append(b" ".join([w for w, g in zip(words, gone_of[i].tolist(), strict=True) if not g] if i in gone_of else words))
        own = {c: group[c] for c in columns}
        A.trim()
        return pa.table(own | {"n_words": n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    by_chunk = lambda df: df.groupBy("_chunk")
    asked = by_chunk(dealt.select(id_col, text_col, "_chunk")).applyInArrow(ask_blocks, "bucket int, chunk int, keys binary, flags binary")
    hits = asked.groupBy("bucket").applyInArrow(answer_blocks, "chunk int, bucket int, keys binary")
    asked = by_chunk(dealt.select(id_col, text_col, "_chunk")).cogroup(hits.groupBy("chunk")).applyInArrow(ask_windows, "bucket int, chunk int, a binary, b binary, doc binary, several binary")
    answers = asked.groupBy("bucket").applyInArrow(answer_windows, "chunk int, a binary, b binary, least binary")
    return by_chunk(dealt).cogroup(answers.groupBy("chunk")).applyInArrow(remove, out_schema)
