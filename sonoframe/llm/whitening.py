"""Whitening of embeddings by covariances that are aggregated as columns.

An entry c, as double, is the integer x = floor(1024 c) + 100000. A first aggregation counts the vectors of each length, a
second one sums x for every dimension. The third is generated: a sum of centred products for each pair of dimensions of the
upper triangle, all in one aggregation, so each task sends one row, whatever it read. LAPACK decomposes the covariance (dimensions squared,
on the driver). Vectors are projected on the leading components, each divided by the root of its eigenvalue, by generated column
expressions; an aggregation over the projected table measures how far their covariance is from the identity.

A pair list longer than `tile` (beyond 90 dimensions) is cut into several aggregations over the columns that each needs.

Means are kept as an integer and a fraction below one, so the offset of x costs no digits. Deviations are exact integers: longs where
count and range prove that they fit, else decimals, null beyond 38 digits.

Vectors that are null, hold null or non-finite components, or one of 2**52 or more in size (x needs a long), take no part. Vectors of different
lengths are not compared: each length is whitened by itself. Components whose eigenvalue is zero but for rounding do not exist, so equal
vectors, a single one and empty ones give no rows. A null id is an id; repeated ids and equal vectors are each a row.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.staging import staged

SCALE, OFFSET = 1024, 100_000


def integral(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float(1 << 52)))
    x = F.transform(v, lambda c: F.floor(c * SCALE) + OFFSET)
    return vectors.filter(F.col(vector_col).isNotNull() & sound & (F.size(vector_col) > 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


class Moments:
    """Number, sums and covariance of the vectors of one length, with the leading eigenpairs."""

    def __init__(self, rows: DataFrame, n: int, largest: int, length: int, components: int, tile: int):
        self.n, self.length, self.largest = n, length, largest
        exact = "bigint" if n * largest < 1 << 62 else "decimal(20,0)"
        self.sums = [int(s) for s in rows.agg(*[F.sum(F.col("x")[i].cast(exact)).alias(f"s{i}") for i in range(length)]).first()]
        self.mean = [s // n for s in self.sums]
        self.rest = [(s - m * n) / n for s, m in zip(self.sums, self.mean, strict=True)]
        self.covariance = self._covariance(rows, tile)
        value, vector = np.linalg.eigh(self.covariance)
        value, vector = value[::-1], vector[:, ::-1]
        there = value > max(value[0], 0) * length * np.finfo(float).eps
        self.k = int(min(components, there.sum()))
        self.eigenvalue, self.component = value[: self.k], vector[:, : self.k]

    def centred(self, i: int) -> Column:
        return (F.col("x")[i] - F.lit(self.mean[i]).cast("bigint")).cast("double") - F.lit(self.rest[i])

    def _covariance(self, rows: DataFrame, tile: int) -> np.ndarray:
        """Sums of centred products of the upper triangle, a column for each pair."""
        pairs = [(i, j) for i in range(self.length) for j in range(i, self.length)]
        v = np.zeros((self.length, self.length))
        for lo in range(0, len(pairs), tile):
            own = pairs[lo : lo + tile]
            needed = sorted({i for p in own for i in p})
            columns = rows.select(*[self.centred(i).alias(f"c{i}") for i in needed])
            found = columns.selectExpr(*[f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in own]).first()
            for (i, j), p in zip(own, found, strict=True):
                v[i, j] = v[j, i] = p / self.n
        return v

    def deviation(self) -> Column:
        """Exact sum of (n x - S)^2."""
        fits = self.length * (2 * self.n * self.largest) ** 2 < 1 << 63
        kind = "bigint" if fits else "decimal(38,0)"
        sums = ", ".join(f"CAST({s} AS {kind})" for s in self.sums)
        apart = f"zip_with(x, array({sums}), (a, s) -> try_subtract(try_multiply(CAST({self.n} AS {kind}), CAST(a AS {kind})), s))"
        return F.expr(f"aggregate({apart}, CAST(0 AS {kind}), (t, d) -> CAST(try_add(t, try_multiply(d, d)) AS {kind}))").cast("decimal(38,0)")

    def projected(self) -> list[Column]:
        w = self.component / np.sqrt(self.eigenvalue)
        return [functools.reduce(operator.add, [F.col(f"c{i}") * F.lit(float(w[i, k])) for i in range(self.length)]) for k in range(self.k)]


def whiten(vectors: DataFrame, components: int = 8, tile: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = integral(vectors, id_col, vector_col)
    size = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("largest")).orderBy("length").collect()  # one row a length
    out = vectors.sparkSession.createDataFrame([], T.StructType([T.StructField("vec_id", vectors.schema[id_col].dataType)]).add("component", "integer").add("n", "long").add("deviation", "decimal(38,0)").add("whitened", "double").add("explained", "double").add("identity_error", "double"))
    for r in lengths:
        own = rows.filter(F.size("x") == r.length)
        m = Moments(own, r.n, r.largest, r.length, components, tile)
        if m.k:
            out = out.unionByName(_whitened(own, m))
    return out


def _whitened(rows: DataFrame, m: Moments) -> DataFrame:
    columns = rows.select("vec_id", m.deviation().alias("deviation"), *[m.centred(i).alias(f"c{i}") for i in range(m.length)])
    done = staged(columns.select("vec_id", "deviation", F.array(*m.projected()).alias("w")), "whitened")
    mean = done.agg(*[F.avg(F.col("w")[i]) for i in range(m.k)]).first()
    w = [F.col("w")[i] - F.lit(mean[i]) for i in range(m.k)]
    pairs = [(i, j) for i in range(m.k) for j in range(i, m.k)]
    found = done.agg(*[F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    error = max(abs(p - (i == j)) for (i, j), p in zip(pairs, found, strict=True))
    explained = F.lit([float(e) for e in m.eigenvalue / np.trace(m.covariance)])
    return done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
