"""Language identification by string kernels.

A text is the set of its blended n-grams (one to three bytes, letters lower-cased, all else a space), hashed
into `dims` places. The kernel of two texts is the number of n-grams that both have, over the root of the product
of how many each has. Landmarks are training texts; one-versus-rest kernel ridge regression is solved in
their Nyström space, and a batch of texts is scored by two matrix products: n-grams by landmarks, kernel by weights.

Learning takes at most per_lang labelled texts of each language (seeded hash order), the first `landmarks` of
them as landmarks; there may be max_langs languages at most, else learning stops with an error.

Nulls: a null text, or one without a letter, is `und` with score 0; rows without id or lang are not learned from;
a null id is not held out; of repeated ids one is learned from, the same in every run. Every row is scored on its own, whatever its length. With nothing to learn from, all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import text_arrays as A
from sonoframe.llm.staging import ship

DIMS = 1 << 14
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
_ODD = np.uint32(0x9E3779B1)


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: a third of the ids by checksum."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which n-grams each text has: a row of DIMS booleans."""
    rows = np.zeros((len(offsets) - 1, DIMS), bool)
    flat = rows.ravel()
    folded = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) * DIMS, np.diff(offsets))
    gram = folded
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] << np.uint32(8) | folded[n - 1 :]
        if not len(gram):
            break
        same = row[: len(gram)] == row[n - 1 :]
        place = (gram * _ODD + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - 14)
        flat[(row[: len(gram)] + place)[same]] = True
    return rows


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


class KernelModel:
    """Landmarks and one-versus-rest weights."""

    def __init__(self, packed: np.ndarray, langs: list[str], landmarks: int, ridge: float = 1e-3):
        self.langs = sorted(set(langs))
        seen: dict[str, int] = {}
        chosen = []
        for i, lang in enumerate(langs):
            seen[lang] = seen.get(lang, 0) + 1
            if seen[lang] <= landmarks:
                chosen.append(i)
        self.packed = packed[chosen]
        texts = np.unpackbits(packed, axis=1).astype(np.float32)
        k = self._kernel(texts)
        targets = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        weight = 1 / np.array([seen[x] for x in langs])  # languages count alike
        left = k.T @ (k * weight[:, None]) + ridge * k[chosen] + 1e-8 * np.eye(len(chosen))
        self.weights = np.linalg.solve(left, k.T @ (targets * weight[:, None]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "marks"}

    def _kernel(self, texts: np.ndarray) -> np.ndarray:
        if not hasattr(self, "marks"):
            self.marks = np.unpackbits(self.packed, axis=1).astype(np.float32)
        own, theirs = texts.sum(axis=1), self.marks.sum(axis=1)
        return ((texts @ self.marks.T) / np.sqrt(np.maximum(own, 1)[:, None] * np.maximum(theirs, 1)[None, :])).astype(np.float64)

    def scores(self, texts: np.ndarray) -> np.ndarray:
        """Probabilities of the languages."""
        raw = 4 * (self._kernel(texts.astype(np.float32)) @ self.weights)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, per_lang: int = 256, landmarks: int = 32, max_langs: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """A model of the languages of rows that are not held out; None without any."""
    ship(docs.sparkSession)
    thin = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"))
    held = {r._lang: r.n for r in thin.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("n")).limit(max_langs + 1).collect()}
    if len(held) > max_langs:
        raise ValueError(f"more than {max_langs} languages: raise max_langs")
    if not held:
        return None
    # the first by hash lie among the few whose hash is small enough for four times as many, so no task sees a language whole
    share = F.element_at(F.create_map(*[x for lang, n in held.items() for x in (F.lit(lang), F.lit(4.0 * per_lang / max(n, 1)))]), F.col("_lang"))
    few = thin.filter(F.col("_h").cast("double") / 2.0**64 + 0.5 <= share).distinct()
    first = few.withColumn("_n", F.row_number().over(W.partitionBy("_lang").orderBy("_h", "_id"))).filter(F.col("_n") <= per_lang)
    sample = first.collect()  # bounded by both parameters
    if not sample:
        return None
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r._id, r._lang) for r in sample], T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_lang", T.StringType())])).distinct())
    own = docs.select(F.col(id_col).alias("_own"), F.col(lang_col).cast("string").alias("_said"), F.col(text_col).alias("_text"))
    texts = own.join(wanted, (F.col("_own") == F.col("_id")) & (F.col("_said") == F.col("_lang"))).select("_id", "_lang", "_text")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffers(batch["_text"])
            packed = [np.packbits(presence(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))).tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_lang"], pa.array(packed, pa.binary())], names=["_id", "_lang", "bits"])

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_lang", T.StringType()), T.StructField("bits", T.BinaryType())])
    one = texts.mapInArrow(A.trimmed(bits), schema).groupBy("_id").agg(F.min(F.struct("_lang", "bits")).alias("_x"))  # of repeated ids always the same
    rows = one.select("_id", "_x._lang", "_x.bits").withColumn("_h", F.xxhash64("_id", F.lit(seed))).orderBy("_lang", "_h").collect()
    packed = np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint8).reshape(len(rows), DIMS // 8)
    return KernelModel(packed, [r._lang for r in rows], landmarks)


def identify(docs: DataFrame, model: KernelModel | None, text_col: str = "text", batch_docs: int = 128) -> DataFrame:
    """docs with lang_pred and score. Input columns of these names are replaced."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = A.buffers(batch[text_col])
            langs, scores = np.full(len(batch), "und", object), np.zeros(len(batch))
            lettered = np.zeros(len(batch), bool)
            for lo, hi in A.pieces(offsets, 1 << 20):  # ASCII letters first
                own, full = data[offsets[lo] : offsets[hi]], np.flatnonzero(np.diff(offsets[lo : hi + 1]))
                if len(full):
                    lettered[lo + full] = np.logical_or.reduceat((_FOLD[own] != 0x20) & (own < 0x80), offsets[lo + full] - offsets[lo])
            for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                lettered[i] = _has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
            runs = [(lo, min(lo + batch_docs, end)) for start, end in A.pieces(offsets) for lo in range(start, end, batch_docs)]
            for lo, hi in runs if model else ():
                p = model.scores(presence(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                best = p.argmax(axis=1)
                langs[lo:hi], scores[lo:hi] = np.array(model.langs, object)[best], p[np.arange(hi - lo), best]
            langs[~lettered], scores[~lettered] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(langs, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(A.trimmed(score), schema)
