"""Operators of the llm subpackage against brute force, round trips and held-out accuracy, with the odd inputs of each."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.llm import alignment, ann, components, decontaminate, langid, mixing, near_dup, quality, queries, sharding, substring_dedup, text_arrays, tokens, toxicity, warc

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    """texts: (doc_id, text); the columns of documents and two that clash with results."""
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, f"s{(i or 0) % 3}"), len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("x"), "n_words": F.lit("y"), "score": F.lit("z"), "shard": F.lit("w")})


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ODD = [(None, "no id at all here"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "!!! ???"), (6, prose(0, 20_000)), (7, "ÀÉ ñandú 日本語"), (7, "ÀÉ ñandú 日本語"), (8, "a b c\x00d")]


def plain(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# --- text arrays


def test_words_and_hashes_equal_a_regex():
    import pyarrow as pa

    texts = [t for _, t in ODD] + [prose(i, i * 7) for i in range(20)]
    data, off = text_arrays.buffers(pa.array(texts).slice(2))
    start, end, count = text_arrays.words(data, off)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts[2:]]
    assert count.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == flat
    seen = {}
    for w, h in zip(flat, text_arrays.word_hashes(data, start, end).tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    hashes = text_arrays.word_hashes(data, start, end)
    win = text_arrays.window_hashes(hashes, 3).tolist()
    assert (win[0] == win[5]) == (flat[0:3] == flat[5:8]) and len(win) == len(flat) - 2
    assert text_arrays.words(np.zeros(0, np.uint8), np.zeros(1, np.int64))[2].tolist() == []


# --- op1


def brute_contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            m = min(10, len(w))
            for k in range(len(w) - m + 1):
                patterns.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for d, t in texts:
        w, hit, ids = words(t), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if own := patterns.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    ids |= own
        out.append((d, len(w), len(hit), tuple(sorted(ids))))
    return out


@pytest.mark.parametrize("broadcast", [1 << 25, 300])
def test_contamination_equals_brute_force(spark, broadcast):
    items = [(10, prose(1, 30, 3000)), (2, prose(2, 12, 3000)), (3, "Short ITEM"), (4, None), (None, "a b"), (5, "..."), (10, prose(1, 30, 3000)), (6, prose(1, 30, 3000))]
    texts = ODD + [(20, "x " + items[0][1].replace(" ", ", ").upper() + " y"), (21, " ".join(items[0][1].split()[:9])), (22, "short-item short item"), (23, items[1][1] + " " + items[0][1]), (24, "日short item")]
    got = decontaminate.find_contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), broadcast)
    rows = [(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got.collect()]
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted(brute_contamination(texts, items), key=key) and "size" in got.columns
    span = next(r for r in got.collect() if r.doc_id == 20).spans
    assert [(s.start, s.end) for s in span] == [(2, len(texts[-5][1]) - 2)]


@pytest.mark.parametrize("base", [decontaminate._LETTERS, 7])
@pytest.mark.parametrize("common", [8, 1, 10**9])
def test_automaton_equals_brute_force_on_random_words(base, common, monkeypatch):
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(8)
    words = lambda n, m: " ".join(f"v{rng.randrange(m)}" for _ in range(n))
    for m in (2, 3, 40):
        items = [(str(k), words(rng.randrange(1, 40), m)) for k in range(25)]
        texts = [(k, words(rng.randrange(80), m) + " " + rng.choice(items)[1] + " " + words(rng.randrange(20), m)) for k in range(40)]
        b = decontaminate.Benchmark(items, base)
        assert b.width == 1 + (base < m)
        for (_, text), (_, n, hit, ids) in zip(texts, brute_contamination(texts, items), strict=True):
            spans, own = b.find(decontaminate.normal_words(text))
            assert (len({x for a, e in spans for x in range(a, e)}), tuple(sorted(own))) == (hit, ids)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert plain(decontaminate.find_contamination(docs(spark, [(1, "a b")]), none), "n_words", "n_hit") == [(2, 0)]
    assert decontaminate.find_contamination(docs(spark, [(1, "a")]).limit(0), none).collect() == []


# --- op2


def brute_repeats(texts, n):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts]
    first = {}
    for d, w in words:
        for k in range(len(w) - n + 1) if d is not None else ():
            p = tuple(w[k : k + n])
            first[p] = min(first.get(p, d), d)
    out = []
    for d, w in words:
        gone = {x for k in range(len(w) - n + 1) if d is not None and first[tuple(w[k : k + n])] < d for x in range(k, k + n)}
        out.append((d, len(w), len(gone), " ".join(v for k, v in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_repeats_equal_brute_force(spark, window):
    rng = random.Random(4)
    shared = [prose(100 + i, rng.choice([window - 1, window, window + 1, 3 * window]), 5000) for i in range(6)]
    texts = ODD + [(None, shared[3])] + [(30 + i, " ".join([prose(i, rng.randrange(60), 5000), rng.choice(shared), prose(i + 50, rng.randrange(30), 5000), rng.choice(shared)])) for i in range(60)]
    texts += [(200 + i, "again " * (window + 20)) for i in range(3)] + [(30, texts[-1][1])]
    got = plain(substring_dedup.remove_repeats(docs(spark, texts), window), "doc_id", "n_words", "n_removed", "kept")
    assert sorted(got, key=str) == sorted(brute_repeats(texts, window), key=str)


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(docs(spark, [(1, "a")]).limit(0)).collect() == []


def test_packing_round_trip():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 500, dtype=np.uint64))
    assert (substring_dedup.unpack(substring_dedup.pack(v, 5), 5) == v).all() and len(substring_dedup.unpack(substring_dedup.pack(v[:0]))) == 0


# --- op3


def test_neighbours_reach_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "k") for i, v in enumerate(x)] + [(9000, None, "k"), (9001, [0.0] * 16, "k"), (9002, [1.0, None] * 8, "k"), (9003, [float("nan")] * 16, "k"), (9004, [1.0] * 3, "k"), (None, [1.0] * 16, "k"), (9050, [float("inf")] * 16, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, leaf_rows=64, bin_rows=256, sample_rows=2048).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true, found = [], {}
    for q in range(0, 3000, 50):
        s = u @ u[q]
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        true += [(q, i) for i in order]
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert len(set(true) & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true) and set(found) == set(range(0, 3000, 50))
    for rs in found.values():
        assert [r.rank for r in sorted(rs, key=lambda r: (-r.score, r.vec_id))] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12 for r in rs)
    assert [r.vec_id for r in sorted(found[100], key=lambda r: r.rank)] == [101, 102, 103, 104, 105]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_every_length_and_size_of_vectors_is_searched(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (50, [0.0, 1e200]), (2, [3e-310, 0.0]), (100, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (4, [1.0, 0.0, 0.0]), (150, [1.0])]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    r2 = 1 / np.sqrt(2)
    want = [(0, 1, 2, 1.0), (0, 2, 1, r2), (0, 3, 50, 0.0), (50, 1, 1, r2), (50, 2, 0, 0.0), (50, 3, 2, 0.0), (100, 1, 3, 1.0), (100, 2, 4, 1 / np.sqrt(14))]
    assert [r[:3] for r in got] == [w[:3] for w in want] and np.allclose([r[3] for r in got], [w[3] for w in want], rtol=0, atol=1e-15)


def test_bins_bound_rows_and_queries():
    b = ann.Bins(5, {0: 10, 1: 5, 2: 45, 4: 3}, {0: 7, 1: 7, 2: 30, 3: 1}, 16, 8)
    assert b.first.tolist() == [0, 0, 1, 3, 4] and b.several.tolist() == [1, 1, 3, 1, 1] and b.copies.tolist() == [2, 4, 4, 4, 1]


@needs_data
def test_small_tables_have_several_leaves_and_exact_results(spark, monkeypatch):
    made, start = [], ann.KMeansTree.__init__
    monkeypatch.setattr(ann.KMeansTree, "__init__", lambda self, *a: made.append(self) or start(self, *a))
    vectors = spark.read.parquet(f"{DATA}/../sf0.01/embeddings.parquet")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in queries.op3_nearest(spark, f"{DATA}/../sf0.01").collect())
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = [(int(q), n + 1, int(ids[i])) for q in ids[ids % 50 == 0] for n, i in enumerate([i for i in np.argsort(-(u @ u[ids == q][0]), kind="stable") if ids[i] != q][:5])]
    assert got == sorted(want) and made[0].n_leaves >= 20


# --- op4, op7


@needs_data
def test_quality_on_held_out_labels(spark):
    d = str(DATA).replace("sf0.001", "sf0.01")
    got = queries.op4_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95 and len(got) > 80


def test_quality_of_odd_inputs(spark):
    d = docs(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 1), (7, 1, 1), (6, None, 0), (None, 1, 0), (99, 1, 0), (2, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, quality.learn(d, labels))
    rows = plain(got, "doc_id", "score", "predicted", "size")
    assert len(rows) == len(ODD) and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p, _ in rows)
    assert plain(quality.classify(d, quality.learn(d, labels.limit(0))).limit(1), "score") == [(0.5,)]
    assert quality.classify(d.limit(0), None).collect() == []


def test_factorisation_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(quality.WORDS + quality.STATS, rank=3)
    m.w = rng.normal(size=m.w.shape).astype(np.float32)
    x = np.zeros((1, len(m.w)), np.float32)
    at = [5, 70, 900, quality.WORDS + 1]
    x[0, at] = [0.5, 1.0, -2.0, 0.25]
    pairs = sum(float(m.v[i] @ m.v[j]) * x[0, i] * x[0, j] for a, i in enumerate(at) for j in at[a + 1 :])
    assert abs(m.raw(x)[0][0] - (m.b + sum(m.w[i] * x[0, i] for i in at) + pairs)) < 1e-4


@needs_data
def test_language_on_held_out_documents(spark):
    d = str(DATA).replace("sf0.001", "sf0.01")
    got = queries.op7_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and len(got) > 200


def test_language_of_odd_inputs(spark):
    d = docs(spark, [*ODD, (9, "日本"), (10, "123 ...")], lang={4: "fr", 6: None})
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, langid.learn(d)).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 5, 10)) and got[9][0] in ("en", "fr") and 0 < got[6][1] <= 1
    assert {r.lang_pred for r in langid.identify(d, langid.learn(d.limit(0))).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.learn(docs(spark, [(i, "abc") for i in range(20)], lang={i: f"l{i}" for i in range(20)}), max_langs=2)


def test_kernel_is_presence_over_root_of_sizes():
    texts = [b"ab ab", b"ab", b""]
    off = np.cumsum([0, *map(len, texts)])
    p = langid.presence(np.frombuffer(b"".join(texts), np.uint8), off)
    assert p.sum(axis=1).tolist() == [3 + 3 + 3, 2 + 1, 0]  # a, b, space; ab, "b ", " a"; "ab ", "b a", " ab"


# --- op5


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(1, "http://www.b.example/x?q=1", big), (5, "https://a.b.example:8080/", big), (0, None, big), (2, "http://c.example", None), (3, "http://c.example", "short"), (4, "bad url [", "short"), (None, "http://n.example", "x" * 150), (6, "http://c.example/z", ""), (7, "\n", "y" * (1 << 20)), (5, "https://a.b.example:8080/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages, archive_bytes=600).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        want = {i: (h or "").encode() for i, _, h in rows}[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 0) if r.page_id in (1, 5) else ("response", None))
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else want)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_look_up(spark, tmp_path):
    rows = [(i, f"http://h{i % 37}.example/p{i % 11}", f"page {i}") for i in range(400)]
    root = f"file://{tmp_path}"
    captures = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), root, archive_bytes=3000)
    directory = sorted(tuple(r) for r in warc.write_index(captures, root, block_lines=20).collect())
    store = warc.Store(root)
    assert len(directory) <= 4 and sum(len(warc.read_lines(store, *d[1:4])) for d in directory) > 15 and sum(d[4] for d in directory) == 400
    for url in ("http://h3.example/p5", "https://www.H3.example/p5", "http://h36.example/p0", "http://none.example/"):
        want = sorted(f"page {i}" for i, u, _ in rows if warc.url_key(u) == warc.url_key(url))
        assert sorted(p.decode() for _, p in warc.look_up(directory, root, url)) == want


def test_a_key_of_many_blocks_is_read_once(spark, tmp_path):
    rows = [(i, "http://hot.example/" if i % 3 else f"http://h{i}.example/", f"page {i}") for i in range(300)]
    root = f"file://{tmp_path}"
    captures = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), root)
    index = warc.write_index(captures, root, block_lines=7)
    wanted = spark.createDataFrame([(warc.url_key(u),) for u in ("http://hot.example/", "http://h30.example/", "http://none.example/", "http://h30.example/")], "key string")
    got = sorted(bytes(r.payload).decode() for r in warc.read_archives(wanted, index, root, batch_bytes=50).collect())
    assert got == sorted(f"page {i}" for i in range(300) if i % 3 or i == 30)
    directory = sorted(tuple(r) for r in index.collect())
    assert len(warc.look_up(directory, root, "http://hot.example/")) == 200


def test_url_keys():
    assert warc.url_key("https://www.Example.org:443/A?b=C#frag") == "org,example)/a?b=c" and warc.url_key("http://x.y:81") == "y,x:81)/" and warc.url_key(None) == ")/"


# --- op6


def test_shards_are_whole_and_stable(spark):
    texts = ODD + [(i, prose(i, 5)) for i in range(100, 1100)]
    d = docs(spark, texts)
    a, b, c = (sharding.shard_documents(x, n, bucket_bytes=2000).collect() for x, n in ((d, 4), (d.repartition(7), 4), (d, 5)))
    key = lambda rs: sorted(((r.doc_id, r.text, r["shard"], r.slot) for r in rs), key=str)
    assert key(a) == key(b) and len(a) == len(texts)
    for s in range(4):
        slots = sorted(r.slot for r in a if r["shard"] == s)
        assert slots == list(range(len(slots))) and 180 < len(slots) < 320
    grown = {r.doc_id: r["shard"] for r in c}
    assert all(r.grown_shard == grown[r.doc_id] and r.grown_shard in (r["shard"], 4) for r in a)
    assert all(r["size"] == len((r.text or "").encode()) + 16 for r in a)
    order = [r.doc_id for r in sorted((r for r in a if r["shard"] == 1 and r.doc_id and r.doc_id >= 100), key=lambda r: r.slot)]
    assert order != sorted(order)
    assert sharding.shard_documents(d.limit(0), 4).collect() == []


def test_fisher_yates_is_a_fair_permutation():
    seen = Counter(tuple(sharding.fisher_yates(3, (s,))) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400 and len(sharding.fisher_yates(0, (1,))) == 0


def test_shards_are_written_in_order(spark, tmp_path):
    placed = sharding.shard_documents(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string"), 3)
    sharding.write_shards(placed, str(tmp_path / "s"))
    found = Counter()
    for f in (tmp_path / "s").glob("shard=*/bucket=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).select("slot").collect()]
        assert slots == sorted(slots)
        found.update((f.parent.parent.name, x) for x in slots)
    assert found == Counter((f"shard={r['shard']}", r.slot) for r in placed.collect())


def test_rows_of_one_id_fill_many_buckets(spark):
    d = spark.createDataFrame([(None if i % 2 else 7, f"text number {i}") for i in range(400)], "doc_id long, text string")
    rows = sharding.shard_documents(d, 4, bucket_bytes=1000).collect()
    held = Counter((r["shard"], r.bucket) for r in rows)
    assert len({r["shard"] for r in rows}) <= 2 and len(held) > 10 and max(held.values()) < 80
    for s in {r["shard"] for r in rows}:
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(n for (k, _), n in held.items() if k == s)))


# --- op8


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    odd = ["a  b", "a \n b\n\n c", "\ta b", "don't we'll  'S", "a b ", " a", "a b 　c", "x\r\ny", "<|endoftext|> a", "½ ² ٣ 12a_b", "é a", "\n", "a\n", "'s 's", "  ", "😀 😀a", "a\n 's", "a  b", "ab\x1cc d", "_a __b"]
    texts = ODD + [(50 + i, t) for i, t in enumerate(odd)] + [(90, prose(3, 3000))]
    library = Tokenizer.from_file(path)  # as it is by default
    want = Counter((i, t, len(library.encode(t or "", add_special_tokens=False))) for i, t in texts)
    got = tokens.count_tokens(docs(spark, texts), "byte_bpe_50k.json")
    assert Counter(plain(got, "doc_id", "text", "n_tokens")) == want and all(r.over_limit == (r.n_tokens > 512) for r in got.collect())
    small = tokens.PretokenCounter(path, memory=10)
    assert [small.count_with_added(t) for _, t in texts] == [n for (_, _, n) in [(i, t, len(library.encode(t or "", add_special_tokens=False))) for i, t in texts]]
    assert tokens.count_tokens(docs(spark, ODD).limit(0), "byte_bpe_50k.json").collect() == []
    library.encode_special_tokens = True  # added tokens as ordinary text
    plain_text = tokens.count_tokens(docs(spark, texts), "byte_bpe_50k.json", added_tokens=False)
    assert Counter(plain(plain_text, "doc_id", "n_tokens")) == Counter((i, len(library.encode(t or "", add_special_tokens=False))) for i, t in texts)
    assert [small.count(t) for _, t in texts] == [len(library.encode(t or "", add_special_tokens=False)) for _, t in texts]


# --- op9


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(texts, threshold=75):
    sets = [(d, shingles(t)) for d, t in texts]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if None not in (a, b) and s and t and 100 * len(s & t) >= threshold * len(s | t) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [(d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets]


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(9999)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("limits", [{}, {"limit": 4, "block_docs": 8}, {"limit": 2, "levels": 1}])
def test_near_copies_equal_brute_force(spark, limits):
    base = [prose(i, 150, 20_000) for i in range(12)]
    texts = ODD + [(100 + i, base[i % 12]) for i in range(24)] + [(200 + i, edited(base[0], 0.05 * (i % 4) / 3, i)) for i in range(60)] + [(300 + i, edited(base[i % 12], 0.03, i)) for i in range(24)]
    texts += [(400, "a b c"), (401, "A B C"), (402, "a b c d"), (100, base[5])]
    rng = random.Random(2)
    rng.shuffle(texts)
    got = plain(near_dup.near_duplicates(docs(spark, texts), **limits), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got, key=str) == sorted(brute_components(texts), key=str)


def test_near_copies_of_an_empty_table(spark):
    assert near_dup.near_duplicates(docs(spark, ODD).limit(0)).collect() == []


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.v: r.c for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exact_links_equal_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(30)]
    got = near_dup.exact_links(sets, 50, width=7)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (len(a) > 0 and len(b) > 0 and 100 * both >= 50 * (len(a) + len(b) - both))


# --- op10


def test_mix_meets_targets(spark):
    texts = [(i, prose(i, 20 + i % 60)) for i in range(900)] + ODD
    source = {i: "big" for i in range(500)} | {i: None for i in range(500, 560)} | {i: f"s{i % 5}" for i in range(560, 900)} | {i: "tiny" for i in range(1, 9)}
    d = docs(spark, texts, source=source)
    rows = mixing.mix_sources(d, shard_words=2000).collect()
    again = mixing.mix_sources(d.repartition(5), shard_words=2000).collect()
    key = lambda rs: sorted(((r.doc_id, r["size"], r.taken) for r in rs), key=str)
    assert key(rows) == key(again) and len(rows) == len(texts)
    assert all(0 <= r.taken <= 3 * r["size"] and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    own, taken, target = Counter(), Counter(), {}
    for r in rows:
        own[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in own if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, free, want = sum(own.values()), set(names), {}
    while True:  # share out, stop those above, share again
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * own[s]}
        if not full:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 3 * own[s] for s in full}
        left -= sum(3 * own[s] for s in full)
        free -= full
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-9 and abs(taken[s] - target[s]) <= 0.02 * target[s] + 20
    copies = Counter(r.doc_id for r in mixing.materialise(mixing.mix_sources(d), d.columns).collect())
    assert max(copies.values()) <= 3 and all(mixing.mix_sources(d).select(*d.columns).columns[k] == c for k, c in enumerate(d.columns))


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, ODD).limit(0)).collect() == []
    assert plain(mixing.mix_sources(docs(spark, [(1, ""), (2, None)])), "target", "taken") == [(0.0, 0)] * 2


def test_sainte_lague_is_highest_quotients(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4, "e": 9.6}
    t = spark.createDataFrame([(k, i, 0, 110, v) for i, (k, v) in enumerate(weights.items())], "_k string, _rn int, _s long, _all long, _t double")
    got = {r._k: r._q for r in mixing.sainte_lague(t, 10).collect()}
    best = sorted(((-v / (2 * k + 1), s) for s, v in weights.items() for k in range(20)))[:11]
    assert got == {**dict.fromkeys(weights, 0), **Counter(s for _, s in best)}


def test_mix_is_native(spark):
    plan = mixing.mix_sources(docs(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- SQL and pipeline


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    from test_oracle import same

    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@needs_data
def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline as cp

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    start = spark.read.parquet(f"{DATA}/documents.parquet").select(*columns)
    extra = spark.createDataFrame([(-1, "123 456", "en", "src1", 7), (-2, None, "en", None, 0), (None, "some words that are not in any other document at all", None, "src1", 5), (0, None, None, None, None)], start.schema)
    now = start.union(extra)
    for k, (name, stage) in enumerate(cp.STAGES):
        before = now.collect()
        after = stage(spark, now, str(DATA))
        if k < 4:
            assert after.columns == columns
            now = spark.createDataFrame(after.collect(), start.schema)
        ids = Counter(r.doc_id for r in (after if k == 4 else now).collect())
        if name == "language":
            assert {-1, -2}.isdisjoint(ids) and ids.keys() >= {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
        elif name == "near_dedup":
            kept = [d for d, _, _, k in brute_components([(r.doc_id, r.text) for r in before]) if k]
            assert ids == Counter(kept)
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert ids == Counter(d for d, _, hit, _ in brute_contamination([(r.doc_id, r.text) for r in before], items) if not hit)
        elif name == "mix":
            assert set(ids) <= {r.doc_id for r in before} and max(ids.values()) <= 3
        else:
            assert ids == Counter(r.doc_id for r in before)
    for _, stage in cp.STAGES:
        assert stage(spark, start.limit(0), str(DATA)).collect() == []


def test_crc_of_held_out(spark):
    got = spark.range(20).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


NAMES = ["_state", "_chunk", "_id", "_own", "_y", "_h", "_lang", "_text", "_n_words", "_text_hash", "_k", "_cell", "_bucket", "_shard", "_order", "_slot", "_size", "_tie", "_key", "_to", "state", "hits", "copy", "_copy", "_meta0", "input column 2"]


@pytest.mark.parametrize("name", ["decontaminate", "decontaminate in parts", "substring_dedup", "quality", "shard", "langid", "tokens", "mix", "materialised mix", "align", "toxicity"])
def test_columns_named_like_internal_ones_come_back_unchanged(spark, name):
    rows = [(i, prose(i, 60 + i), "en" if i % 2 else "de", f"s{i % 3}", 7) for i in range(40)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id")) for n in NAMES})
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(k, prose(k, 12)) for k in range(6)], "item_id long, text string")
    work = {
        "decontaminate": lambda: decontaminate.find_contamination(table, items),
        "decontaminate in parts": lambda: decontaminate.find_contamination(table, items, max_broadcast_bytes=100),
        "substring_dedup": lambda: substring_dedup.remove_repeats(table),
        "quality": lambda: quality.classify(table, quality.learn(table, labels)),
        "shard": lambda: sharding.shard_documents(table, 4),
        "langid": lambda: langid.identify(table, langid.learn(table)),
        "tokens": lambda: tokens.count_tokens(table, "byte_bpe_50k.json"),
        "mix": lambda: mixing.mix_sources(table),
        "materialised mix": lambda: mixing.materialise(mixing.mix_sources(table, weights=(1,)), table.columns),
        "align": lambda: alignment.align(table, "byte_bpe_50k.json", "piece_bpe_32k.model"),
        "toxicity": lambda: toxicity.classify(table, toxicity.learn(table, labels)),
    }[name]()
    found = work.collect()
    assert {r.doc_id for r in found} == set(range(40)) and (len(found) == 40 or name == "materialised mix")
    assert all(r[n] == f"{n}:{r.doc_id}" for r in found for n in NAMES)
    if name.startswith("decontaminate"):
        assert {r.doc_id for r in found if r.n_hit} == set(range(6))


def test_short_items_inside_longer_ones_at_every_place():
    long = [f"w{i}" for i in range(23)]
    items = [("long", " ".join(long))]
    items += [(f"short{n}-{a}", " ".join(long[a : a + n])) for n in range(1, 10) for a in range(0, 23 - n)]
    items += [(f"copy{k}", " ".join([f"x{k}"] * 3 + long[5:15])) for k in range(decontaminate.COMMON + 3)]  # a block of more owners than COMMON
    texts = ["x " + " ".join(long[a : a + n]) + " y" for n in (4, 5, 6, 9, 10, 12) for a in range(0, 23 - n, 2)] + [" ".join(long), "a " + " ".join(long[5:10]) + " b"]
    for chosen in (items, items[::-1], [i for i in items if i[0] in ("long", "short5-5", "short5-0")]):
        machine = decontaminate.Benchmark(chosen)
        for text in texts:
            words = text.split()
            hit, ids = set(), set()
            for i, t in chosen:
                w = t.split()
                m = min(10, len(w))
                for win in {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}:
                    for k in range(len(words) - m + 1):
                        if tuple(words[k : k + m]) == win:
                            hit.update(range(k, k + m))
                            ids.add(i)
            spans, found = machine.find([x.encode() for x in words])
            assert found == ids and {x for a, b in spans for x in range(a, b)} == hit, text
