"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Text and items are normalised alike: A-Z lower-cased, words of letters, digits and all beyond ASCII. Each distinct word of
the items is one letter of the automaton's alphabet (two, if there are more words than letters), any other word is one that
no item has, so a text is a string with a letter a word and is scanned once. Patterns are the items' blocks of five words that do
not overlap, and whole items of fewer than ten words. Any window of ten words of an item holds one of its blocks: around each
occurrence text and item are compared five words to either side, and runs of ten or more equal words are hits. Hits are
word numbers, which are mapped to character offsets in the original. A block that many items share gives way to all windows that
hold it.

The items' texts go to every worker, where the automaton is built once and kept under a digest of its items, so that
another benchmark never meets it. It takes about 40 MB for 1 MB of items. A benchmark beyond max_broadcast_bytes is dealt by hash
into parts; each is a pass of its own over the written result of the one before, adding to what that found.

Nulls: a null text has no words and is never hit; an item whose id or text is null, or without words, takes
no part. Items of one id count once. Equal rows are each judged. An empty benchmark hits nothing. Input
columns named like a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import text_arrays as A
from sonoframe.llm.staging import free, ship, staged

WINDOW = 10
#: words of a pattern: two of them less one word fit into a window, so each window holds a whole one
BLOCK = 5
#: a block of more places of the items gives way to the windows around it, so that no occurrence is compared with more places
COMMON = 8
#: each byte as normalised: lower case, what parts words is a space
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_PARTS = np.array([c == 0x20 for c in _NORMAL])
_built: dict = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _letter(number: int) -> str:
    return chr(number + 1 if number + 1 < 0xD800 else number + 0x801)  # no surrogates


_UNKNOWN = "\0"
_LETTERS = 0x10FFFF - 0x800 - 1


class Benchmark:
    """The items' automaton. letters: at least two digits of `base` letters make a word where there are more words than letters."""

    def __init__(self, items: list[tuple[str, str]], base: int = _LETTERS):
        import ahocorasick

        split = [(i, w) for i, text in items if (w := normal_words(text))]
        vocabulary = list(dict.fromkeys(x for _, w in split for x in w))
        self.width = 1 if len(vocabulary) <= base else 2
        spell = _letter if self.width == 1 else lambda n: _letter(n // base) + _letter(n % base)
        self.code = {w: spell(n) for n, w in enumerate(vocabulary)}
        self.unknown = _UNKNOWN * self.width
        self.ids = [i for i, _ in split]
        self.texts = [self.encode(w) for _, w in split]
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, text in enumerate(self.texts):
            n = len(text) // self.width
            for at in range(0, n - BLOCK + 1, BLOCK) if n >= WINDOW else [-1]:
                owners.setdefault(text if at < 0 else text[at * self.width : (at + BLOCK) * self.width], []).append((k, at))
        for pattern in [p for p, own in owners.items() if sum(at >= 0 for _, at in own) > COMMON]:
            common = owners.pop(pattern)
            if whole := [x for x in common if x[1] < 0]:
                owners[pattern] = whole
            for k, at in (x for x in common if x[1] >= 0):  # the windows that hold this block, as patterns of their own
                for first in range(max(0, at - WINDOW + BLOCK), min(at, len(self.texts[k]) // self.width - WINDOW) + 1):
                    owners.setdefault(self.texts[k][first * self.width : (first + WINDOW) * self.width], []).append((k, -1))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, pattern in enumerate(owners):
            self.machine.add_word(pattern, k)
        self.wholes = [sorted({self.ids[k] for k, at in own if at < 0}) for own in owners.values()]
        self.blocks = [list(dict.fromkeys(x for x in own if x[1] >= 0)) for own in owners.values()]
        self.sizes = [len(p) // self.width for p in owners]
        if owners:
            self.machine.make_automaton()

    def encode(self, words: list[bytes]) -> str:
        get, unknown = self.code.get, _UNKNOWN * self.width
        return "".join([get(w, unknown) for w in words])

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """First and end word of each run of hit words, and the items' ids."""
        spans: list[tuple[int, int]] = []
        ids: set[str] = set()
        if not self.sizes:
            return spans, ids
        text, w = self.encode(words), self.width
        whole: set[int] = set()
        for end, k in self.machine.iter(text):
            if (end + 1) % w:
                continue
            stop = (end + 1) // w
            start = stop - self.sizes[k]
            if self.wholes[k]:
                spans.append((start, stop))
                if k not in whole:
                    whole.add(k)
                    ids.update(self.wholes[k])
            for item, at in self.blocks[k]:
                own, left, right = self.texts[item], 0, 0
                most = min(WINDOW - BLOCK, start, at)
                while left < most and text[(start - left - 1) * w : (start - left) * w] == own[(at - left - 1) * w : (at - left) * w]:
                    left += 1
                most = min(WINDOW - BLOCK, len(text) // w - stop, len(own) // w - at - BLOCK)
                while right < most and text[(stop + right) * w : (stop + right + 1) * w] == own[(at + BLOCK + right) * w : (at + BLOCK + right + 1) * w]:
                    right += 1
                if left + BLOCK + right >= WINDOW:
                    spans.append((start - left, stop + right))
                    ids.add(self.ids[item])
        return spans, ids


def _benchmark(items: list[tuple[str, str]], key: str) -> Benchmark:
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(items)
    return _built[key]


def _scan(data: np.ndarray, offsets: np.ndarray, benchmark: Benchmark) -> tuple[np.ndarray, dict]:
    """Words of each text, and for texts that are hit: (first and end word of each run, item ids)."""
    n_words = np.zeros(len(offsets) - 1, np.int64)
    found: dict[int, tuple[list, set]] = {}
    for i in range(len(n_words)):
        words = data[offsets[i] : offsets[i + 1]].tobytes().translate(_NORMAL).split()
        n_words[i] = len(words)
        spans, ids = benchmark.find(words)
        if spans:
            found[i] = spans, ids
    return n_words, found


def _spans(raw: bytes, hit: np.ndarray) -> list[dict]:
    """Character offsets in the original of each run of hit words."""
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = A.words(data, np.array([0, len(raw)]), _PARTS)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(chars[start[a]]), "end": int(chars[end[b - 1]])} for a, b in edge.reshape(-1, 2)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_broadcast_bytes: int = 32 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted strings) and spans (start and end character of hit passages)."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).dropna().distinct()
    n_parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / max_broadcast_bytes))
    results = ["n_words", "n_hit", "item_ids", "spans"]
    kept = [c for c in docs.columns if c.lower() not in results]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    for part in range(n_parts):
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_parts)) == part) if n_parts > 1 else items
        held = sorted((r.i, r.t) for r in own.collect())
        out = _apply(out, spark.sparkContext.broadcast(held), _digest(held), kept, part == n_parts - 1, text_col)
        if part < n_parts - 1:
            out = staged(out, "benchmark-part")
    return out


def _digest(items: list[tuple[str, str]]) -> str:
    """Names the automaton of these items."""
    return hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest()


def _apply(docs: DataFrame, sent, key: str, kept: list[str], last: bool, text_col: str) -> DataFrame:
    state = free(kept, "state")
    found_so_far = state in docs.columns
    schema = T.StructType([docs.schema[c] for c in kept])
    held = T.StructType().add("first", T.ArrayType(T.IntegerType())).add("stop", T.ArrayType(T.IntegerType())).add("ids", T.ArrayType(T.StringType()))
    ends = schema.add("n_words", "long").add("n_hit", "long").add("item_ids", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))) if last else schema.add(state, held)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    held_type = pa.struct([("first", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32())), ("ids", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = _benchmark(sent.value, key)
        for batch in batches:
            data, offsets = A.buffers(batch[text_col])
            n_words, found = _scan(data, offsets, benchmark)
            if found_so_far:
                for i, before in enumerate(batch[state].to_pylist()):
                    if before:
                        at = found.setdefault(i, ([], set()))
                        at[0].extend(zip(before["first"], before["stop"], strict=True))
                        at[1].update(before["ids"])
            own = [batch[c] for c in kept]
            if not last:
                rows = [{"first": [a for a, _ in found[i][0]], "stop": [b for _, b in found[i][0]], "ids": sorted(found[i][1])} if i in found else None for i in range(len(batch))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(rows, held_type)], names=[*kept, state])
                continue
            n_hit, ids, spans = np.zeros(len(batch), np.int64), [[]] * len(batch), [[]] * len(batch)
            for i, (hits, owners) in found.items():
                step = np.zeros(n_words[i] + 1, np.int64)
                np.add.at(step, [a for a, _ in hits], 1)
                np.add.at(step, [b for _, b in hits], -1)
                hit = np.cumsum(step)[:-1] > 0
                n_hit[i], ids[i] = hit.sum(), sorted(owners)
                spans[i] = _spans(data[offsets[i] : offsets[i + 1]].tobytes(), hit)
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words), pa.array(n_hit), pa.array(ids, pa.list_(pa.string())), pa.array(spans, spans_type)], names=[*kept, "n_words", "n_hit", "item_ids", "spans"])

    return docs.mapInArrow(A.trimmed(scan), ends)
