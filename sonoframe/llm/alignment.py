"""Alignment of the tokens of two tokenizers: A of the tokenizers library (byte-level), B of sentencepiece.

A text is encoded as space+text; tokens are intervals of its bytes. Offsets where tokens of both end cut them into groups, and the two
tokens that end at such an offset are linked. How often two ids are linked anywhere is their pair's count.

In each Arrow partition DuckDB aligns: the tokens of both are interval tables, an ASOF join finds for each token of A the last of B that
ends no later and keeps those that end together, window sums number the groups, a range join puts the tokens of B into them, and an aggregation counts
pairs. Partial counts are merged in Spark. Linked tokens end together, so one's bytes are the end of the other's: there are no more pairs
than both vocabularies have bytes (about half a million), whatever the corpus. That bounds the table of counts that is sent to tasks to score every
document's links, which the first pass has staged.

Texts repeat their words, so what is aligned are chunks: a text is cut at each space between two other characters. No pre-token of A reaches
across such a place, and no piece of B does if none of its vocabulary holds a space after another character; that is proven once from the file,
and where it fails (or A's file has another pre-tokenizer) a text is one chunk. Each chunk is aligned once while it stays in the worker's bounded
memory; a document's groups are those of its chunks, one after the other.

Texts that are null or empty, or whose tokens' bytes differ from space+text in A or B, have no tokens: zeros and an empty string. Strings of special
tokens are plain text. Each row is counted by itself: repeated rows and ids all count. Very long texts are whole and need memory in
proportion to one text. Extra columns are kept; those named like a result are replaced.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import text_arrays as A
from sonoframe.llm.staging import ship, staged
from sonoframe.llm.tokens import located

RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ready: dict[tuple[str, str], Chunks] = {}

#: chunks lie one after the other on one axis of bytes, so positions alone order and join the tokens
LINKS = """
CREATE OR REPLACE TEMP TABLE link AS
SELECT a.place AS a_place, a.id AS a_id, b.id AS b_id, a.stop FROM a ASOF JOIN b ON a.stop >= b.stop WHERE a.stop = b.stop
"""
SPANS = """
CREATE OR REPLACE TEMP TABLE span AS
SELECT row_number() OVER (ORDER BY stop) - 1 AS g, lag(stop, 1, 0) OVER (ORDER BY stop) AS start, stop FROM link
"""
GROUPS_A = """
SELECT coalesce(sum(CAST(link.a_place IS NOT NULL AS INTEGER)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM a LEFT JOIN link ON a.place = link.a_place ORDER BY place
"""
GROUPS_B = "SELECT g FROM b JOIN span ON b.start >= span.start AND b.stop <= span.stop ORDER BY place"


class Tokenizers:
    """Ids of both tokenizers, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # fixed values: bytes that byte-level vocabularies write as themselves
        others = iter(range(0x100, 0x200))
        byte_of = {chr(b) if b in printable else chr(next(others)): b for b in range(0x100)}
        n = self.a.get_vocab_size(with_added_tokens=True)
        added = self.a.get_added_tokens_decoder()
        self.a_bytes = [added[i].content.encode() if i in added else bytes(byte_of.get(c, 0x3F) for c in self.a.id_to_token(i) or "") for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size, self.b_size = (np.array([len(b) for b in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        written = [str(i).encode() for i in range(max(n, len(self.b_bytes)))]
        size = np.array([len(w) for w in written])
        self.decimal = (np.frombuffer(b"".join(written), np.uint8), np.cumsum(size) - size, size)
        self.kind = np.int32 if n * len(self.b_bytes) < 1 << 31 else np.int64  # holds any pair of ids
        self.cuts = self._cuts(a_path)

    def _cuts(self, a_path: str) -> bool:
        """Whether both tokenizers provably cut at a space between other characters."""
        with open(a_path, encoding="utf-8") as f:
            said = json.load(f)
        plain = said.get("normalizer") is None and said.get("pre_tokenizer", {}).get("type") == "ByteLevel" and not said["pre_tokenizer"].get("add_prefix_space") and said["pre_tokenizer"].get("use_regex", True)
        whole = all(b" " not in b.lstrip(b" ") or self.b.is_control(i) or self.b.is_unknown(i) for i, b in enumerate(self.b_bytes))
        return plain and whole and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b")

    def chunks(self, text: str) -> list[str]:
        """space+text cut at spaces between other characters."""
        return _CUT.split(f" {text}") if self.cuts else [f" {text}"]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both, one chunk after the other, and how many bytes each chunk has: none where the tokens' bytes are not its own.

        Chunks that end in another character than white space are encoded joined, as both tokenizers cut between them anyway.
        """
        size = np.zeros(len(chunks), np.int64)
        flat: tuple[list[int], list[int]] = ([], [])
        runs, at = [], 0
        while at < len(chunks):
            stop = at + 1
            while self.cuts and stop < len(chunks) and stop - at < 2048 and not chunks[stop - 1][-1].isspace():
                stop += 1
            runs.append((at, stop))
            at = stop
        texts = ["".join(chunks[lo:hi]) for lo, hi in runs]
        for (lo, hi), text, a, b in zip(runs, texts, self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            a, raw = a.ids, text.encode("utf-8", "replace")
            if self._same(a, b, raw):
                size[lo:hi] = [len(c) for c in chunks[lo:hi]] if len(raw) == len(text) else [len(c.encode("utf-8", "replace")) for c in chunks[lo:hi]]
                flat[0].extend(a)
                flat[1].extend(b)
                continue
            for k in range(lo, hi):  # some chunk's bytes are not kept: each by itself
                raw, a, b = chunks[k].encode("utf-8", "replace"), self.a.encode(chunks[k], add_special_tokens=False).ids, self.b.encode(chunks[k][1:])
                if self._same(a, b, raw):
                    size[k] = len(raw)
                    flat[0].extend(a)
                    flat[1].extend(b)
        return np.array(flat[0], np.int64), np.array(flat[1], np.int64), size

    def _same(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw


class Chunks:
    """What is known of each chunk: tokens, groups and linked pairs, in arrays by number."""

    def __init__(self, a_path: str, b_path: str, memory: int = 160_000):
        import duckdb

        self.tokenizers = Tokenizers(a_path, b_path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        self.memory = memory
        self.number: dict[str, int] = collections.defaultdict(itertools.count().__next__)
        self.groups: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, whether the bytes are the text's
        self.pairs, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the chunks that were met most, at most half of the memory."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.memory // 2])
        kept = kept[self.uses[kept] > 1]
        names = list(self.number)
        self.number = collections.defaultdict(itertools.count(len(kept)).__next__, {names[i]: k for k, i in enumerate(kept.tolist())})
        self.groups = [self.groups[i] for i in kept.tolist()]
        self.counts, self.uses = self.counts[kept], self.uses[kept] // 2
        self.pairs = self.pairs[_ranges(self.first[kept], self.first[kept + 1])]
        self.first = np.concatenate([[0], np.cumsum(self.first[kept + 1] - self.first[kept])])

    def learn(self, chunks: list[str]) -> None:
        """Aligns new chunks, all of them in one set of tables."""
        *flat, size = self.tokenizers.encode(chunks)
        ends = np.cumsum(size)
        counts = np.zeros((len(chunks), 4), np.int64)
        counts[:, 3] = size > 0
        for k, (name, ids, bytes_of) in enumerate(zip("ab", flat, (self.tokenizers.a_size, self.tokenizers.b_size), strict=True)):
            stop = np.cumsum(bytes_of[ids])
            counts[:, k] = np.bincount(np.searchsorted(ends, stop), minlength=len(chunks))
            self.db.register(name, pa.table({"place": np.arange(len(ids)), "id": ids, "start": stop - bytes_of[ids], "stop": stop}))
        self.db.execute(LINKS)
        self.db.execute(SPANS)
        link = self.db.sql("SELECT a_id, b_id, stop FROM link ORDER BY stop").to_arrow_table()
        g_a, g_b = (self.db.sql(q).to_arrow_table()["g"].to_numpy() for q in (GROUPS_A, GROUPS_B))
        counts[:, 2] = np.bincount(np.searchsorted(ends, link["stop"].to_numpy()), minlength=len(chunks))
        last = np.cumsum(counts[:, 2]) - 1
        self.groups += self._written(flat, g_a, g_b, last[counts[:, 2] > 0], counts)
        self.counts, self.uses = np.concatenate([self.counts, counts]), np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])
        self.pairs = np.concatenate([self.pairs, link["a_id"].to_numpy() * len(self.tokenizers.b_bytes) + link["b_id"].to_numpy()])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts[:, 2])])
        for name in "ab":
            self.db.unregister(name)

    def _written(self, ids: list[np.ndarray], g_a: np.ndarray, g_b: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each chunk's groups as text: ids of A before those of B, and after each id what parts it from the next."""
        n_a, n_b = len(g_a), len(g_b)
        at_a = np.arange(n_a) + np.searchsorted(g_b, g_a)
        at_b = np.arange(n_b) + np.searchsorted(g_a, g_b, side="right")
        token, mark = np.zeros(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        token[at_a], token[at_b] = ids
        mark[at_a[np.flatnonzero(np.diff(g_a, append=-1))]] = ord("|")
        after = np.flatnonzero(np.diff(g_b, append=-1))  # one for each group
        mark[at_b[after]] = ord(";")
        digits, place, size = self.tokenizers.decimal
        out_size = size[token] + 1
        stop = np.cumsum(out_size)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
        out[stop - 1] = mark
        out[_ranges(stop - out_size, stop - 1)] = digits[_ranges(place[token], place[token] + size[token])]
        text, edges = out.tobytes(), iter(stop[at_b[after]][ends].tolist())
        written, lo = [], 0
        for n in counts[:, 2].tolist():
            hi = next(edges) if n else lo
            written.append(text[lo : hi - 1] if n else b"")
            lo = hi
        return written

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The chunks' numbers of each text; None for a text without tokens."""
        if len(self.number) > self.memory:
            self.forget()
        known, before = self.number, len(self.number)
        number, cut = known.__getitem__, self.tokenizers.chunks  # a chunk that is new gets the next number
        numbers = [np.fromiter(map(number, cut(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if len(known) > before:
            self.learn(list(itertools.islice(known, before, None)))
        self.uses += np.bincount(np.concatenate([np.zeros(0, np.int64), *numbers]), minlength=len(self.uses))
        return [k if len(k) and self.counts[k, 3].all() else None for k in numbers]

    def count_pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each pair is linked in these occurrences of chunks: each chunk's pairs times its occurrences."""
        if not len(numbers):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chunk, times = np.unique(numbers, return_counts=True)
        at = _ranges(self.first[chunk], self.first[chunk + 1])
        self.db.register("occurs", pa.table({"pair": self.pairs[at], "times": np.repeat(times, self.first[chunk + 1] - self.first[chunk])}))
        found = self.db.sql("SELECT pair, CAST(sum(times) AS BIGINT) AS times FROM occurs GROUP BY pair ORDER BY pair").to_arrow_table()
        self.db.unregister("occurs")
        return found["pair"].to_numpy(), found["times"].to_numpy()


def _ranges(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers from each first to its stop, one range after the other."""
    size = stop - first
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that hold the numbers from each end to the next."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def scored_links(whole: pa.RecordBatch, kind: type, pair: np.ndarray, count: np.ndarray, best: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their numbers of links and of best links, and the sum of counts; sums need some ten times the bytes of a run's links, so runs are about 1 MB."""
    for lo, hi in A.pieces(A.buffers(whole["links"])[1]):
        batch = whole.slice(lo, hi - lo)
        raw, offsets = A.buffers(batch["links"])
        links = raw.view(kind) if len(raw) else np.zeros(0, kind)
        at = np.searchsorted(pair, links)
        stop = offsets // np.dtype(kind).itemsize
        sums = (np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)])[stop] if len(at) else np.zeros(hi - lo + 1, np.int64) for v in (best, count))
        yield batch, np.diff(stop), *map(np.diff, sums)


def align(docs: DataFrame, a: str, b: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; a and b: files, or names among the public tokenizers.

    Without keep_text the result has no text, so none is written between the passes."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    held_columns = [c for c in kept if keep_text or c != text_col]
    order = [f"k{i}" for i in range(len(held_columns))]  # input columns, under names that nothing else has
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(order, held_columns, strict=True)]
    text_at = "text"
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("a", "b", "g"))]).add("sha", "string").add("links", "binary").add("pairs", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.LongType()))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (located(a), located(b))
        if key not in _ready:
            _ready[key] = Chunks(*key)
        chunks = _ready[key]
        for whole in batches:
            offsets = A.buffers(whole[text_at])[1]
            for lo, hi in A.pieces(offsets, 1 << 20):
                batch = whole.slice(lo, hi - lo)
                numbers = chunks.texts(batch[text_at].to_pylist())
                none = np.zeros(0, np.int64)
                rows = [none if k is None else k for k in numbers]
                flat = np.concatenate([none, *rows])
                total = np.zeros((len(flat) + 1, 3), np.int64)
                np.cumsum(chunks.counts[flat, :3], axis=0, out=total[1:])
                stop = np.cumsum([len(k) for k in rows])
                sums = total[stop] - total[stop - [len(k) for k in rows]]
                sha = [None if k is None else hashlib.sha256(b";".join([chunks.groups[i] for i in k.tolist()])).hexdigest() for k in numbers]
                links = chunks.pairs[_ranges(chunks.first[flat], chunks.first[flat + 1])]
                ends = np.concatenate([[0], np.cumsum(chunks.first[flat + 1] - chunks.first[flat])])[np.concatenate([[0], stop])]
                held = [*(batch[n] for n in order), *(pa.array(sums[:, i]) for i in range(3)), pa.array(sha, pa.string()), _packed(links.astype(chunks.tokenizers.kind), ends), *(pa.nulls(len(batch), pa.list_(pa.int64())) for _ in range(2))]
                yield pa.RecordBatch.from_arrays(held, names=schema.names)
                pair, times = chunks.count_pairs(flat)
                counted = [*(pa.nulls(1, batch[n].type) for n in order), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([pair], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(counted, names=schema.names)

    done = staged(docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(order, held_columns, strict=True)], F.col(f"`{text_col}`").alias(text_at)).mapInArrow(A.trimmed(first_pass), schema), "align")
    partial = done.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("x.pairs").agg(F.sum("x.times").alias("n"))
    merged = partial.toArrow()  # no more rows than both vocabularies have bytes
    both = Tokenizers(located(a), located(b))
    width, kind = len(both.b_bytes), both.kind
    pair, count = merged["pairs"].to_numpy(), merged["n"].to_numpy()
    turn = np.argsort(pair)
    pair, count = pair[turn], count[turn]
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, pair % width, count)
    sent = spark.sparkContext.broadcast((pair, count, count == highest[pair % width]))
    last = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("a", "b", "g", "l", "best", "sum"))]).add("sha", "string")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ready.clear()  # this worker may still hold the first pass's memory
        for whole in batches:
            for batch, size, best, count in scored_links(whole, kind, *sent.value):
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in order), batch["a"], batch["b"], batch["g"], pa.array(size), pa.array(best), pa.array(count), batch["sha"]], names=last.names)

    scored = done.filter("links IS NOT NULL").drop("pairs", "times").mapInArrow(A.trimmed(second_pass), last)
    names = dict(zip(order, held_columns, strict=True)) | dict(zip(("a", "b", "g", "l", "best", "sum"), RESULT, strict=False))
    return scored.select(*[F.col(n).alias(c) for n, c in names.items()], F.coalesce("sha", F.lit("")).alias("groups_sha256"))
