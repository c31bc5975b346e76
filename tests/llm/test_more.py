"""Whitening, alignment and toxicity against slow versions, and their odd inputs."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import alignment, toxicity, whitening
from sonoframe.llm.queries import QUERIES
from sonoframe.llm.tokens import located

SF = "/root/testdata/sf0.001"
VECTORS = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("n", "string").add("w", "string")
DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("n_a", "string").add("score", "string").add("k0", "long").add("pairs", "string")


def plain_whitening(rows, k=8):
    x = np.array([[int(np.floor(float(np.float32(c)) * 1024)) + 100000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    y = (x.astype(float) * 1.0) - np.array([float(b) / n for b in s])
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1], vector[:, ::-1]
    return deviation, (y @ vector[:, :k]) / np.sqrt(value[:k]), value[:k] / value.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) @ np.diag([3, 2, 1, 1.5, 0.5, 0.1])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(7, rows[7][1])]  # a repeated row
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0]), (905, [])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + odd], VECTORS).repartition(5)
    for tile in (4096, 5):
        found = whitening.whiten(table, tile=tile).collect()
        assert len(found) == 301 * 6 and {r.n for r in found} == {301} and max(r.identity_error for r in found) < 1e-9
        deviation, w, explained = plain_whitening(rows, 6)
        for i, (vec_id, _) in enumerate(rows):
            own = [r for r in found if r.vec_id == vec_id]
            assert {int(r.deviation) for r in own} == {deviation[i]}
            for r in own:
                assert abs(abs(r.whitened) - abs(w[i, r.component - 1])) < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-12


def test_whitening_of_flat_and_empty_tables(spark):
    flat = spark.createDataFrame([(i, [1.0, 2.0], "x", "y") for i in range(5)], VECTORS)
    assert whitening.whiten(flat).count() == 0 and whitening.whiten(flat.limit(0)).count() == 0
    line = spark.createDataFrame([(None if i == 3 else i, [float(i), 2.0 * i], "x", "y") for i in range(9)], VECTORS)
    found = whitening.whiten(line).collect()
    assert len(found) == 9 and {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-9
    huge = spark.createDataFrame([(i, [1e15 * i, -1e15 * i * i], "x", "y") for i in range(4)], VECTORS)
    assert {r.identity_error < 1e-6 for r in whitening.whiten(huge).collect()} == {True}


def plain_alignment(texts):
    """Tokens of whole texts by both libraries, links and counts without chunks or DuckDB."""
    both = alignment.Tokenizers(located("byte_bpe_50k.json"), located("piece_bpe_32k.model"))
    rows, counts = [], collections.Counter()
    for text in texts:
        rows.append(None)
        if not text:
            continue
        a, b, whole = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text), f" {text}".encode()
        if b"".join(both.a_bytes[i] for i in a) != whole or b"".join(both.b_bytes[i] for i in b) != whole:
            continue
        stop_a, stop_b = (np.cumsum([len(own[i]) for i in ids]).tolist() for own, ids in ((both.a_bytes, a), (both.b_bytes, b)))
        groups, links, i, j = [], [], 0, 0
        for stop in sorted(set(stop_a) & set(stop_b)):
            p, q = stop_a.index(stop) + 1, stop_b.index(stop) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        counts.update(links)
        rows[-1] = (len(a), len(b), ";".join(groups), links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for r in rows:
        if r is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            yield (r[0], r[1], len(r[3]), len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(r[2].encode()).hexdigest())


ODD_TEXTS = [None, "", " ", "  two  spaces ", "a\tb\n\n c ", "<|endoftext|> and <s> text", "▁ lower", "naïve Größe 東京 🎉", "x" * 5000, "end ", "\x1c odd \x85 white　space", "it's we'll they've", "the the the", "the the the"]


@pytest.mark.parametrize("cuts", [True, False])
def test_alignment_equals_brute_force(spark, cuts, monkeypatch):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    if not cuts:
        chunks = alignment.Chunks(located("byte_bpe_50k.json"), located("piece_bpe_32k.model"))
        chunks.tokenizers.cuts = False
        whole = chunks.texts(texts)
        cut = alignment.Chunks(located("byte_bpe_50k.json"), located("piece_bpe_32k.model"), memory=50)
        for text, k in zip(texts, whole, strict=True):  # one at a time: chunks are forgotten and learned again
            (j,) = cut.texts([text])
            assert (j is None) == (k is None)
            if k is not None:
                assert b";".join(cut.groups[i] for i in j) == b";".join(chunks.groups[i] for i in k) and cut.counts[j, :3].sum(axis=0).tolist() == chunks.counts[k, :3].sum(axis=0).tolist()
        return
    docs = spark.createDataFrame([(i, t, "x", "y", 5, "z") for i, t in enumerate(texts)], DOCS).repartition(3)
    found = {r.doc_id: r for r in alignment.align(docs, "byte_bpe_50k.json", "piece_bpe_32k.model").collect()}
    for i, wanted in enumerate(plain_alignment(texts)):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == wanted, texts[i]
        assert (r.score, r.k0, r.pairs) == ("y", 5, "z")
    assert alignment.align(docs.limit(0), "byte_bpe_50k.json", "piece_bpe_32k.model").count() == 0


def test_toxicity_on_rows_that_nothing_was_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    found = toxicity.classify(docs, model).withColumn("out", toxicity.held_out()).join(labels, "doc_id").filter("out").toPandas()
    clean, toxic = found[found.toxic == 0], found[found.toxic == 1]
    assert clean.predicted.mean() < 0.05 and toxic.predicted.mean() >= 0.5
    assert toxicity.learn(docs, labels) == model


def test_toxicity_of_odd_inputs(spark):
    words = ["grass", "river", "stone", "cloud", "light", "green", "under", "water"]
    rng = np.random.default_rng(2)
    texts = [" ".join([*rng.choice(words, 30), *(["blargh"] if i % 3 == 0 else []), *rng.choice(words, 5)]) for i in range(90)]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, "c") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    odd = [(1, None), (2, ""), (3, "..."), (4, "river stone"), (5, "River, BLARGH!"), (6, "water " * 100_000 + "blargh"), (6, "water " * 100_000 + "blargh"), (None, "blargh")]
    found = toxicity.classify(spark.createDataFrame([(i, t, "a", "b", 1, "c") for i, t in odd], DOCS), model)
    assert found.columns == ["doc_id", "text", "n_a", "k0", "pairs", "score", "predicted"]
    assert [r.predicted for r in found.collect()] == [0, 0, 0, 0, 1, 1, 1, 1] and all(0 <= r.score <= 1 for r in found.collect())
    assert toxicity.learn(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.classify(docs, None).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), model).count() == 0
    whole = toxicity.Windows(*toxicity._joined([b"a b a", b"", b"B c"]))
    assert whole.count.tolist() == [3, 0, 2] and sorted(whole.contexts().tolist()) == [1, 2, 2]


@pytest.mark.parametrize("name", ["op11_whiten", "op12_align", "op13_toxicity"])
def test_registered(spark, name):
    found = QUERIES[name](spark, SF)
    rows = found.count()
    assert rows == {"op11_whiten": 8, "op12_align": 1, "op13_toxicity": 1}[name] * spark.read.parquet(f"{SF}/{'embeddings' if name == 'op11_whiten' else 'documents'}.parquet").count()
    assert found.filter(" OR ".join(f"`{c}` IS NULL" for c in found.columns)).count() == 0


def recall_of_search(spark, vectors, calibration):
    """Share of the true five nearest that the search finds, over queries that it was not calibrated on."""
    from sonoframe.llm.ann import nearest

    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(6)
    found = nearest(table, F.col("vec_id") % 20 == 0, calibration=calibration).toPandas()
    x = np.array([v / np.linalg.norm(v) for v in vectors.astype(np.float32).astype(float)])
    hit = total = 0
    for q in range(0, len(x), 20):
        near = x @ x[q]
        near[q] = -2
        true = set(np.argsort(-near, kind="stable")[:5].tolist())
        hit += len(true & set(found[found.query_id == q].vec_id))
        total += 5
    return hit / total


@pytest.mark.parametrize("kind", ["plain", "clustered"])
def test_recall_on_queries_that_were_not_calibrated_on(spark, kind):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(80, 32)) * 3
    vectors = rng.normal(size=(8000, 32)) + (centres[rng.integers(0, 80, 8000)] if kind == "clustered" else 0)
    assert recall_of_search(spark, vectors, calibration=24) >= 0.95  # 400 queries


def test_recall_of_near_duplicates_in_large_nodes(spark):
    """Planted pairs at a similarity of 0.77 or more among documents that share half of their shingles: nodes are large and branch."""
    import random

    from sonoframe.llm.near_dup import near_duplicates

    rng = random.Random(6)
    common = [f"c{i}" for i in range(60)]
    rows, wanted = [], []
    for k in range(1200):
        own = common + [f"o{k}-{i}" for i in range(60)]
        rows.append((2 * k, " ".join(own)))
        if k % 3 == 0:
            changed = list(own)
            changed[70 + rng.randrange(40)] = f"x{k}"
            changed[-1] = f"y{k}"
            rows.append((2 * k + 1, " ".join(changed)))
            a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (own, changed))
            if 100 * len(a & b) >= 75 * len(a | b):
                wanted.append(2 * k)
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(wanted) == 400 and sum(found[i + 1] == i for i in wanted) >= 396
    assert sum(found[i] != i for i, _ in rows if i % 2 == 0) == 0  # no others are linked
