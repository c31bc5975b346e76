"""Quality classification by a factorisation machine.

A document is a sparse vector: its hashed words (damped counts, length one), statistics of its structure, and
metadata columns. The machine has a weight and `rank` factors for each feature; all pairwise interactions are
scored in linear time as half the difference of squared sums and sums of squares, for a batch of documents by
three matrix products.

It is fitted by logistic loss on at most max_rows labelled rows (seeded hash order) that are not held out.
Labels, language, source and id are never features.

Nulls: a null text is an empty one; null metadata is 0; labels without id or with another value than 0 and 1 are
not learned from; a null id is not held out. Of repeated ids one is learned from, the same in every run; ids may be of any
type. Texts are scored in pieces of about 1 MB, a longer text is a piece of its own. Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import text_arrays as A
from sonoframe.llm.langid import held_out
from sonoframe.llm.staging import ship

WORDS = 1 << 13
_CLASSES = [[*range(0x41, 0x5B)], [*range(0x61, 0x7B)], [*range(0x30, 0x3A)], [*range(0x80, 0x100)], [0x21], [0x7C], [*b"#$%&*"], [*b".,;:?"], [0x0A], [0x20]]
STATS = len(_CLASSES) + 6


def _dense(data: np.ndarray, offsets: np.ndarray, metadata: np.ndarray) -> np.ndarray:
    """A row of WORDS word features, STATS statistics and the metadata for each text."""
    n = len(offsets) - 1
    start, end, count = A.words(data, offsets)
    hashes = A.word_hashes(data, start, end, lower=True)
    row = np.repeat(np.arange(n), count)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % WORDS
    x = np.bincount(row * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS).astype(np.float32)
    distinct = (x > 0).sum(axis=1)
    x = np.log1p(x)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    size = np.maximum(np.diff(offsets), 1)
    total = np.zeros(len(data) + 1, np.int64)
    stats = []
    for own in _CLASSES:
        table = np.zeros(256, bool)
        table[own] = True
        np.cumsum(table[data], out=total[1:])
        stats.append(np.sqrt((total[offsets[1:]] - total[offsets[:-1]]) / size))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    words = np.maximum(count, 1)
    length = end - start
    odd = np.zeros(256, bool)
    odd[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
    stats += [
        np.sqrt(np.bincount(row, again, minlength=n) / words),
        np.minimum(distinct / words, 1),
        np.log1p(count) / 10,
        np.bincount(row, length, minlength=n) / words / 20,
        np.sqrt(np.bincount(row, odd[data[end - 1]] if len(end) else None, minlength=n) / words),
        np.sqrt(np.bincount(row, length > 25, minlength=n) / words),
    ]
    return np.concatenate([x, np.stack(stats, axis=1).astype(np.float32), metadata.astype(np.float32)], axis=1)


class FactorisationMachine:
    """y = b + w.x + half the sum over factors of (v.x)^2 - (v^2).(x^2), on standardised statistics."""

    def __init__(self, n_features: int, rank: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.b, self.w = 0.0, np.zeros(n_features, np.float32)
        self.v = rng.normal(0, 0.05, (n_features, rank)).astype(np.float32)
        self.mean, self.scale = np.zeros(n_features, np.float32), np.ones(n_features, np.float32)

    def standardise(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, WORDS:] = np.clip((x[:, WORDS:] - self.mean[WORDS:]) / self.scale[WORDS:], -4, 4)
        return x

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ self.v
        return self.b + x @ self.w + 0.5 * ((s * s).sum(axis=1) - (x * x) @ (self.v * self.v).sum(axis=1)), s

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.standardise(x))[0].astype(np.float64), -30, 30)))

    def fit(self, batches, n_rows: int, epochs: int = 12, rate: float = 0.08, decay: float = 1e-5) -> None:
        """batches(order) -> dense rows and labels of those numbers; AdaGrad on logistic loss."""
        rng = np.random.default_rng(5)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(n_rows)
            for i in range(0, n_rows, 128):
                x, y = batches(order[i : i + 128])
                x = self.standardise(x)
                raw, s = self.raw(x)
                g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(y)).astype(np.float32)
                dw = x.T @ g + decay * self.w
                dv = x.T @ (g[:, None] * s) - ((x * x).T @ g)[:, None] * self.v + decay * self.v
                db = float(g.sum())
                gw += dw * dw
                gv += dv * dv
                gb += db * db
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= rate * dv / np.sqrt(gv)
                self.b -= rate * db / np.sqrt(gb)


def _metadata(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    if not columns:
        return np.zeros((len(batch), 0))
    return np.stack([np.log1p(np.maximum(np.nan_to_num(batch[c].cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)), 0)) / 10 for c in columns], axis=1)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",)) -> FactorisationMachine | None:
    """A machine fitted to a bounded sample of labelled rows; None without any."""
    spark = docs.sparkSession
    ship(spark)
    thin = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    thin = thin.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"))
    sample = thin.orderBy("_h", "_id", "_y").limit(max_rows).collect()
    if not sample:
        return None
    labelled = dict(reversed([(r._id, r._y) for r in sample]))
    wanted = F.broadcast(spark.createDataFrame(list(labelled.items()), T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_y", T.IntegerType())])))
    columns = list(metadata)
    names = [f"_meta{i}" for i in range(len(columns))]
    own = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    texts = own.join(wanted, F.col("_own") == F.col("_id")).drop("_own")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffers(batch["_text"])
            meta = _metadata(batch, names)
            out = []
            for i in range(len(batch)):
                x = _dense(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), meta[i : i + 1])[0]
                at = np.flatnonzero(x).astype(np.int32)
                out.append((at.tobytes(), x[at].tobytes()))
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_y"].cast(pa.int32()), pa.array([a for a, _ in out], pa.binary()), pa.array([v for _, v in out], pa.binary())], names=["id", "y", "at", "value"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("y", "integer").add("at", "binary").add("value", "binary")
    one = texts.mapInArrow(A.trimmed(sparse), schema).groupBy("id").agg(F.min(F.struct("y", "at", "value")).alias("x"))  # of repeated ids always the same
    rows = one.select("id", "x.*").orderBy("id").collect()
    if not rows:
        return None
    at = [np.frombuffer(r["at"], np.int32) for r in rows]
    value = [np.frombuffer(r["value"], np.float32) for r in rows]
    y = np.array([r["y"] for r in rows], np.float32)
    width = WORDS + STATS + len(columns)

    def batches(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(order), width), np.float32)
        for k, i in enumerate(order):
            x[k, at[i]] = value[i]
        return x, y[order]

    machine = FactorisationMachine(width)
    stats = np.concatenate([batches(np.arange(i, min(i + 128, len(y))))[0][:, WORDS:] for i in range(0, len(y), 128)])
    machine.mean[WORDS:], machine.scale[WORDS:] = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    machine.fit(batches, len(y))
    return machine


def classify(docs: DataFrame, machine: FactorisationMachine | None, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), batch_docs: int = 128) -> DataFrame:
    """docs with score and predicted. Input columns of these names are replaced."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            data, offsets = A.buffers(batch[text_col])
            meta = _metadata(batch, list(metadata))
            scores = np.full(len(batch), 0.5)
            for lo, hi in [(lo, min(lo + batch_docs, end)) for start, end in A.pieces(offsets) for lo in range(start, end, batch_docs)] if machine else ():
                scores[lo:hi] = machine.score(_dense(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], meta[lo:hi]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(A.trimmed(score), schema)
