"""Line deduplication, whitening and importance resampling against plain loops, NumPy and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import linededup, resampling, whitening

# ---------------------------------------------------------------- line deduplication


def plain_key(line):
    return line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})


def plain_kept(rows, least=20, copies=3):
    """[(id, lines before, lines dropped, text)] of (id, text) rows."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(plain_key(line)) >= least:
                holders[plain_key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [i is not None and len(holders[plain_key(x)]) >= copies and i != max(holders[plain_key(x)]) if len(plain_key(x)) >= least else False for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def shared_lines():
    r = random.Random(8)
    lines = ["The same line of every licence text", "  the SAME line of every licence text\t", "Éine Zeile, die überall ÉINMAL vorkommt", "éine Zeile, die überall éinmal vorkommt", "short", "", "\x0b\x0c", "exactly twenty signs", "exactly 19 signs ..", "日本語の行がここに二十文字以上並んでいる例です"]
    rows = []
    for i in range(60):
        own = [f"a line of document {i} alone, number {j}" for j in range(r.randint(0, 3))]
        text = r.sample(lines, r.randint(0, len(lines))) + own + r.sample(lines, r.randint(0, 3))
        r.shuffle(text)
        rows.append((i, "\n".join(text)))
    return rows + [(7, rows[7][1]), (7, rows[8][1]), (3, None), (61, None), (62, ""), (63, "\n"), (64, "\n\n" + lines[0] + "\n"), (None, lines[0]), (None, None), (65, "\n".join([lines[0]] * 500))]


@pytest.mark.parametrize("share", [128, 4], ids=["light", "heavy keys"])
def test_line_dedup_by_plain_loops(spark, monkeypatch, share):
    monkeypatch.setattr(linededup, "HEAVY", share)
    rows = shared_lines()
    df = spark.createDataFrame([(*x, 1, "a", "b") for x in rows], "doc_id long, text string, n_lines int, pos string, h1 string").repartition(5)
    if share == 4:
        assert linededup.heavy_keys(linededup.stored(linededup.line_hashes(df))) is not None
    done = linededup.deduplicated(df)
    assert done.columns == ["doc_id", "text", "n_lines", "pos", "h1", "_n_lines", "n_dropped", "kept_text"]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = sorted(((r["doc_id"], r["_n_lines"], r["n_dropped"], r["kept_text"]) for r in done.collect()), key=order)
    assert got == sorted(plain_kept(rows), key=order)
    assert {(r.n_lines, r.pos, r.h1) for r in done.select("n_lines", "pos", "h1").collect()} == {(1, "a", "b")}


def test_line_dedup_general_interface(spark):
    rows = [(i, f"abc\nx{i}\nABC ") for i in range(4)]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), least=3, copies=2).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == plain_kept(rows, 3, 2)
    bits = {r.doc_id: [(x.start, x.lines) for x in r.kept] for r in linededup.bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), least=3, copies=2).collect()}
    assert bits == {i: [(1, 1)] for i in range(3)}


def test_line_dedup_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in linededup.deduplicated(odd).collect()), key=order)
    assert got == sorted(plain_kept(rows), key=order)
    assert linededup.deduplicated(empty).count() == 0


def test_line_dedup_is_native_and_same_as_sql(spark, sf_dir, same, capsys, monkeypatch):
    same(linededup.query, linededup.SQL)
    monkeypatch.setattr(linededup, "HEAVY", 1)  # no heavy keys: the windows need no exchange but the range partitioning
    linededup.query(spark, sf_dir).explain()
    linededup.lost_lines(linededup.stored(linededup.line_hashes(linededup.table(spark, sf_dir, "documents")))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "rangepartitioning(h1" in plan and "hashpartitioning(h1" not in plan


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n = len(x)
    r = x - x.sum(axis=0) / n
    values, components = np.linalg.eigh(r.T @ r / n)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    return n, deviation, r @ components / np.sqrt(values), values, components, np.trace(r.T @ r / n)


def held_against_plain(rows, ids, vectors, k):
    n, deviation, white, values, _, trace = plain_whitening(vectors, k)
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert sorted(got) == sorted(ids)
    for i, at in enumerate(ids):
        assert sorted(got[at]) == list(range(1, k + 1))
        assert all(r.n == n and r.deviation == deviation[i] and r.identity_error < 1e-9 for r in got[at].values())
    for c in range(k):
        mine, theirs = np.array([got[at][c + 1].whitened for at in ids]), white[:, c]
        assert np.allclose(mine * np.sign(mine @ theirs), theirs, atol=1e-7)
        assert abs(got[ids[0]][c + 1].explained / (values[c] / trace) - 1) < 1e-9


def test_whitening_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    held_against_plain(whitening.query(spark, sf_dir).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def made_vectors(n=300, d=20, falling=0.3):
    r = np.random.default_rng(5)
    return (r.standard_normal((n, d)) * 50 * falling ** np.arange(d)) @ np.linalg.qr(r.standard_normal((d, d)))[0]


def test_range_finder_converges_or_expands(spark):
    made = made_vectors()
    vectors = whitening.stored(whitening.quantized(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>").repartition(6), 64, 1_000_000, "vec_id", "embedding"))
    _, _, _, values, components, _ = plain_whitening(made, 3)
    steep = whitening.fit(vectors, 3, oversampling=4, power_passes=12)
    assert not steep.expanded and steep.passes > 1  # the residuals are met by a basis of seven columns
    short = whitening.fit(vectors, 3, oversampling=1, power_passes=1)
    assert short.expanded and short.passes == 3
    for model in (steep, short):
        assert np.allclose(model.values, values, rtol=1e-10) and np.allclose(np.abs((model.components * components).sum(axis=0)), 1, atol=1e-10)


def test_whitening_odd_rows(spark):
    made = made_vectors(80, 6, 0.8).round(3).tolist()
    bad = [(900, None), (901, [None] * 6), (902, [1.0] * 5 + [float("nan")]), (903, [float("-inf")] * 6), (904, [1.0] * 5), (905, []), (906, [1e300] + [0.0] * 5)]
    rows = [*enumerate(made), (5, made[5]), (5, made[6])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows, *bad]], "vec_id long, embedding array<double>, component int, n string").repartition(4)
    n, deviation, *_ = plain_whitening([v for _, v in rows], 6)
    got = whitening.whiten(df).collect()
    assert len(got) == 6 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(zip([i for i, _ in rows], deviation, strict=True))
    with_null = whitening.whiten(df.withColumn("vec_id", F.when(F.col("vec_id") != 3, F.col("vec_id")))).where("vec_id is null").count()
    assert with_null == 6
    for nothing in (df.where("false"), df.where("vec_id = 3"), df.where("vec_id = 905"), df.where("vec_id >= 900 and vec_id < 904")):
        assert whitening.whiten(nothing).collect() == []


def test_whitening_of_a_flat_direction_and_of_wide_numbers(spark):
    flat = [(i, [float(i % 7), 2.0 * (i % 7), float(i % 3)]) for i in range(42)]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    wide = [(i, [float(1 << 54) * (i % 5 - 2), float(1 << 54) * (i % 3 - 1)]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    assert all((r.deviation is None) == (r.vec_id % 15 != 7) for r in got)  # no long holds the others; 7 is the mean


# ---------------------------------------------------------------- importance resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_features(text, max_n=1):
    words = plain_words(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def plain_resampled(rows, target, max_n=1, buckets=10_000, least=20, percent=10, seed=2024):
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text in rows:
        np.add.at(s, [c % buckets for c in plain_features(text, max_n)], 1)
    for text in target:
        np.add.at(t, [c % buckets for c in plain_features(text, max_n)], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    out, able = [], []
    for i, text in rows:
        found = plain_features(text, max_n)
        weight = sum(gain[c % buckets] for c in found) // max(len(found), 1)
        score = None
        if i is not None:
            score = weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if i is not None and len(plain_words(text)) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0], r[2], r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=str)


def test_crc_algebra(texts):
    assert resampling.TABLE[1] == zlib.crc32(b"\x01") ^ zlib.crc32(b"\x00") and resampling._byte_table()[255] == 0x2D02EF8D
    r = random.Random(2)
    parts = [(r.randbytes(r.randint(0, 3000)), r.randbytes(r.choice([0, 1, 2, 7, 300, 100_000]))) for _ in range(40)]
    crcs = [np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1)]
    assert resampling.combined(crcs[0], crcs[1], np.array([len(b) for _, b in parts])).tolist() == [zlib.crc32(a + b) for a, b in parts]
    for size in (1, 63, 64, 65, 127, 128, 129, 1000, 54321):
        word = np.frombuffer(r.randbytes(size), np.uint8)
        assert resampling.word_crcs(word, np.array([0]), np.array([size])).tolist() == [zlib.crc32(word.tobytes())]
    for array in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array([""] * 3), pa.array([], pa.string())):
        for n, (crc, offsets) in enumerate(resampling.features_of(array, 4)):
            for i, text in enumerate(array.to_pylist()):
                words = plain_words(text)
                assert crc[offsets[i] : offsets[i + 1]].tolist() == [zlib.crc32(" ".join(words[j : j + n + 1]).encode()) for j in range(len(words) - n)]


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_by_plain_loops(spark, odd, sf_dir, max_n):
    extra = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 2000).alias("doc_id"), "text")
    df = odd.unionByName(extra, allowMissingColumns=True).unionByName(extra.where("doc_id % 7 = 0"), allowMissingColumns=True)
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = resampling.resampled(df, target, max_n=max_n).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_resampled(rows, [r.text for r in target.collect()], max_n)


def test_resampling_of_copies_and_of_nothing(spark, empty, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 7)
    rows = [(1, "word " * 30)] * 40 + [(i, f"other words {i} " * 9) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, resampling.resampled(df, empty, percent=60).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == plain_resampled(rows, [], percent=60)
    assert resampling.resampled(empty, df).count() == 0
    assert {r.rank for r in resampling.resampled(df.where("doc_id < 5").limit(3), df).collect()} == {None}


def test_resampling_leans_to_the_target(spark):
    r = random.Random(6)
    near, far = [f"quark{i}" for i in range(50)], [f"bread{i}" for i in range(50)]
    rows = [(i, " ".join(r.choices(near if i % 4 == 0 else far, k=40))) for i in range(800)]
    target = spark.createDataFrame([(" ".join(r.choices(near, k=200)),) for _ in range(20)], "text string")
    drawn = resampling.resampled(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(drawn) == 80 and sum(x.doc_id % 4 == 0 for x in drawn) >= 78


def test_resampling_same_as_sql(same):
    same(resampling.query, resampling.SQL)
