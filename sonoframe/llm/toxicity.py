"""Toxicity by compression distance: separate zstandard dictionaries for toxic and for ordinary text.

A window is a word with the spaces around it (A-Z as a-z). It is compressed with each dictionary, and the distance is how many bytes the toxic
one saves, for each byte of the window. A fixed lead that both dictionaries hold follows every window: it makes sure that a window
is never stored as it is, and that matches are searched up to the window's end, so lengths differ by what the dictionaries know. A document's
value is the largest distance of its windows; the score is a logistic curve around a calibrated threshold (0.5 there).

Learning uses a bounded sample of labelled rows: at most max_rows of each class by seeded hash, texts of at most max_bytes. The ordinary dictionary is trained on
ordinary text. The toxic one is trained on those windows of toxic text that are at least `ratio` times as frequent there, counted by different
neighbours on both sides, so that copies and repeated lines count once. How frequent a window must be, the size of the toxic dictionary and the threshold are calibrated
together on folds that the dictionary was not trained on, for the fewest errors at the labels' own rates.

Labels, language, source and id are never inputs of a score. Nulls: a null text is an empty one, and texts without words score lowest; labels without id or with another
value than 0 and 1 are not learned from; a null id is not held out. Of repeated ids one text and one label are learned from, the same in every run; ids may be of any type. Without
labels of both classes nothing is called toxic: every score is 0. Scoring is map-only and each row by itself, in pieces of about 4 MB; a longer text is a
piece of its own, and each different window of a piece is compressed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import text_arrays as A
from sonoframe.llm.staging import ship

_PARTS = np.zeros(256, bool)
_PARTS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_PARTS[0x41:0x5B] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
LEAD = bytes(range(0x60, 0x20, -1))
LEVEL, SLOPE = 9, 16.0
_ready: dict[bytes, object] = {}


@dataclass
class Distance:
    """What scoring needs: contents of both dictionaries and the threshold of a document's value."""

    toxic: bytes
    ordinary: bytes
    threshold: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = Windows(data, offsets)
        value = w.values(savings(w.texts(), self.ordinary, self.toxic))
        return 1 / (1 + np.exp(-np.clip(SLOPE * (value - self.threshold), -60, 60)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class Windows:
    """The windows of a run of texts: each different one once, and where it occurs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        self.start, self.end, self.count = A.words(self.data, offsets, _PARTS)
        self.hashes = A.word_hashes(self.data, self.start, self.end)
        self.distinct, self.first, self.which = np.unique(self.hashes, return_index=True, return_inverse=True)

    def texts(self) -> tuple[bytes, np.ndarray]:
        """The different windows one after the other, each with its lead, and (place, length) of each."""
        start, length = self.start[self.first], (self.end - self.start)[self.first]
        size = length + 2 + len(LEAD)
        place = np.cumsum(size) - size
        out = np.full(int(size.sum()), 0x20, np.uint8)
        lead = np.frombuffer(LEAD, np.uint8)
        out[(place + length + 2)[:, None] + np.arange(len(LEAD))] = lead
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(place + 1, length) + at] = self.data[np.repeat(start, length) + at]
        return out.tobytes(), np.stack([place, size], axis=1).astype(np.uint64)

    def values(self, saved: np.ndarray) -> np.ndarray:
        """The largest of each text, -1 without any."""
        out = np.full(len(self.count), -1.0)
        some = np.flatnonzero(self.count)
        if len(some):
            out[some] = np.maximum.reduceat(saved[self.which], (np.cumsum(self.count) - self.count)[some])
        return out

    def contexts(self) -> np.ndarray:
        """How many different pairs of neighbours each different window has."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        before, after = np.roll(self.hashes, 1), np.roll(self.hashes, -1)
        stop = np.cumsum(self.count)
        before[(stop - self.count)[self.count > 0]] = 0
        after[(stop - 1)[self.count > 0]] = 0
        with np.errstate(over="ignore"):
            around = A.mix(before * np.uint64(3) + A.mix(after + np.uint64(1)))
        pairs = np.unique(np.stack([self.which.astype(np.uint64), around], axis=1), axis=0)
        return np.bincount(pairs[:, 0].astype(np.int64), minlength=len(self.distinct))


def _compressor(content: bytes):
    """A compressor with this dictionary content, made once in a process."""
    import zstandard

    if content not in _ready:
        if len(_ready) > 8:
            _ready.clear()
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        _ready[content] = zstandard.ZstdCompressor(dict_data=held, compression_params=settings)
    return _ready[content]


def _lengths(windows: tuple[bytes, np.ndarray], content: bytes) -> np.ndarray:
    import zstandard

    text, places = windows
    if not len(places):
        return np.zeros(0)
    found = _compressor(content).multi_compress_to_buffer(zstandard.BufferWithSegments(text, places.tobytes()), threads=1)
    return np.fromiter(map(len, found), np.float64, len(found))


def savings(windows: tuple[bytes, np.ndarray], ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves, for each byte of a window."""
    return (_lengths(windows, ordinary) - _lengths(windows, toxic)) / (windows[1][:, 1].astype(float) - len(LEAD))


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary and the lead; the samples themselves where there are too few to train on."""
    import zstandard

    try:
        content = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(dict.fromkeys(samples))[-size:]
    return content + LEAD


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


class Fold:
    """Dictionaries from some toxic and ordinary texts."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], ratio: float, ordinary_size: int):
        t, o = Windows(*_joined(toxic)), Windows(*_joined(ordinary))
        n_t, n_o = t.contexts(), o.contexts()
        among = np.zeros(len(t.distinct), np.int64)
        _, mine, theirs = np.intersect1d(t.distinct, o.distinct, assume_unique=True, return_indices=True)
        among[mine] = n_o[theirs]
        marked = n_t / max(1, n_t.sum()) >= ratio * (among + 0.5) / max(1, n_o.sum())
        text, places = t.texts()
        self.windows = [(int(n), text[int(p) : int(p + s) - len(LEAD)]) for n, (p, s) in zip(n_t[marked], places[marked].astype(np.int64), strict=True)]
        plain = [b" ".join([b"", *(o.data[a:b].tobytes() for a, b in zip(o.start[lo:hi], o.end[lo:hi], strict=True)), b""]) for hi, lo in ((k, k - n) for k, n in zip(np.cumsum(o.count), o.count, strict=True))]
        self.ordinary = dictionary([p[i : i + 200] for p in plain for i in range(0, len(p), 200)], ordinary_size, 64)

    def toxic(self, least: int, size: int) -> bytes | None:
        """A dictionary of the marked windows with `least` contexts, each as often as it has contexts, in the order of a hash."""
        samples = [(n, w) for n, w in self.windows if n >= least]
        if not samples:
            return None
        turned = sorted((hash_of(w, i), w) for n, w in samples for i in range(n))
        return dictionary([w for _, w in turned], size, 16)


def hash_of(window: bytes, i: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(window, i)


def fit(toxic: list[bytes], ordinary: list[bytes], rate: float, ratio: float = 8.0, folds: int = 3, least: tuple[int, ...] = (3, 6, 12, 24, 48), sizes: tuple[int, ...] = (512, 2048), ordinary_size: int = 1 << 16) -> Distance | None:
    """Dictionaries of all texts with the frequency, size and threshold that make the fewest errors on left-out folds; rate: share of toxic rows among the labels."""
    if not toxic or not ordinary:
        return None
    value: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(folds):
        fold = Fold([t for i, t in enumerate(toxic) if i % folds != k], [t for i, t in enumerate(ordinary) if i % folds != k], ratio, ordinary_size)
        tests = [Windows(*_joined(texts[k::folds])) for texts in (toxic, ordinary)]
        plain = [_lengths(w.texts(), fold.ordinary) for w in tests]
        for n in least:
            for size in sizes:
                own = fold.toxic(n, size)
                if own is not None:
                    values = [w.values((p - _lengths(w.texts(), own)) / (w.texts()[1][:, 1].astype(float) - len(LEAD))) for w, p in zip(tests, plain, strict=True)]
                    value.setdefault((n, size), []).append((values[0], values[1]))
    best = None
    for (n, size), found in value.items():
        if len(found) < folds:
            continue
        t, o = (np.sort(np.concatenate(v)) for v in zip(*found, strict=True))
        for at in np.unique(np.concatenate([t, o])):
            errors = rate * np.searchsorted(t, at) / len(t) + (1 - rate) * (len(o) - np.searchsorted(o, at)) / len(o)
            below = max([x for x in (t[np.searchsorted(t, at) - 1] if np.searchsorted(t, at) else -1.0, o[np.searchsorted(o, at) - 1] if np.searchsorted(o, at) else -1.0)])
            if best is None or (errors, -at) < best[0]:
                best = ((errors, -at), n, size, (at + max(below, at - 0.1)) / 2)
    whole = Fold(toxic, ordinary, ratio, ordinary_size)
    if best is None or (own := whole.toxic(best[1], best[2])) is None:
        return None
    return Distance(own, whole.ordinary, float(best[3]))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, max_bytes: int = 1 << 16, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Distance | None:
    """Dictionaries and threshold from a bounded sample of labelled rows that are not held out; None without both classes."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    thin = known.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y")).withColumn("h", F.xxhash64("id", F.lit(seed)))
    count = {r.y: r["count"] for r in thin.groupBy("y").count().collect()}  # two rows
    if len(count) < 2:
        return None
    bound = {y: min(1.0, 4 * max_rows / n) for y, n in count.items()}  # only rows of small hashes are ranked
    chosen = [r for y in (0, 1) for r in thin.filter((F.col("y") == y) & (F.pmod("h", F.lit(1 << 30)) <= int(bound[y] * (1 << 30)))).orderBy("h", "id").limit(max_rows).collect()]
    wanted = F.broadcast(spark.createDataFrame([(r.id, r.y) for r in chosen], T.StructType([T.StructField("id", labels.schema[id_col].dataType), T.StructField("y", T.IntegerType())])))  # 2 * max_rows rows at most
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter((F.octet_length("text") > 0) & (F.octet_length("text") <= max_bytes)).join(wanted, F.col("doc") == F.col("id"))
    rows = texts.groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id").collect()
    sides = [[r.text.encode("utf-8", "replace") for r in rows if r.y == y] for y in (1, 0)]
    return fit(*sides, rate=count[1] / (count[0] + count[1]))


def classify(docs: DataFrame, model: Distance | None, text_col: str = "text") -> DataFrame:
    """docs with score and predicted. Input columns of these names are replaced."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores = np.zeros(len(batch))
            if model is not None:
                data, offsets = A.buffers(batch[text_col])
                for lo, hi in A.pieces(offsets, 1 << 22):
                    scores[lo:hi] = model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(A.trimmed(score), schema)
