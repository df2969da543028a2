"""Crowds of texts that are near each other but not similar: rows in proportion to the texts, groups as by brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lumengrid.llm import simhash
from lumengrid.llm.components import components
from tests.llm.test_corpus import edited, plain_components, plain_groups


def crowd(n, seed, edits):
    r = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    return [(i, " ".join(edited(base, r, r.choice(edits)))) for i in range(n)]


def test_a_crowd_makes_no_pairs(spark, monkeypatch):
    """Of 200 texts of which most pairs share cells and are not similar, no more rows are joined or sent than in proportion."""
    rows = crowd(200, 5, [3, 4, 5])
    made = []
    for name in ("verified", "set_edges"):
        if hasattr(simhash, name):
            real = getattr(simhash, name)

            def counted(first, *rest, real=real, name=name):
                out = simhash.stored(real(first, *rest))
                made.append(first.count() if name == "verified" else out.count())
                return out

            monkeypatch.setattr(simhash, name, counted)
    got = {x.doc_id: x.group_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(rows)
    assert {i: g for (i, _), g in want.items()} == got
    assert 1 < len(set(got.values())) < 200
    assert sum(made) < 3 * len(rows)


@pytest.mark.parametrize("limit", [60, 400, 1 << 19])
def test_parts_of_a_cell_lose_no_link(spark, limit):
    """Sets of several sizes and links in two cells, in one part and in many: the groups of all pairs of a cell, given groups kept."""
    r = np.random.default_rng(8)
    sets = []
    for _ in range(6):
        base = r.integers(0, 2**32, 90)
        for _ in range(12):
            kept = base[r.random(len(base)) < r.choice([0.85, 0.9, 0.95])]
            sets.append(np.unique(np.concatenate([kept, r.integers(0, 2**32, r.integers(0, 9))]).astype("<u4")))
    sets += [np.arange(1, dtype="<u4"), np.arange(4, dtype="<u4"), np.arange(5, dtype="<u4")]
    cell = [i % 2 for i in range(len(sets))]
    comp = [i - i % 4 if i < 12 else i for i in range(len(sets))]
    size = [sum(len(s) for s, d in zip(sets, cell, strict=True) if d == c) for c in (0, 1)]
    members = spark.createDataFrame([(c, size[c], i, comp[i]) for i, c in enumerate(cell)], "cell long, tokens long, node long, comp long")
    table = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, hashes binary")
    edges = simhash.set_edges(members, table, 0.8, limit)
    roots = {x.node: x.root for x in components(edges).collect()}
    linked = lambda i, j: comp[i] == comp[j] or cell[i] == cell[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
    want = plain_components(range(len(sets)), linked)
    by, mine = {}, {}
    for i, w in enumerate(want):
        by.setdefault(w, set()).add(i)
        mine.setdefault(roots.get(comp[i], comp[i]), set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))
    assert 5 < len(by) < len(sets) - 5


def test_rows_without_an_id_are_compared(spark):
    """F3 of round 4: of near duplicates that all have a null id one stays, with all its columns; crowds, repeated rows and null texts among them."""
    texts = [t for _, t in crowd(40, 3, [0, 1, 4])]
    rows = [(None, t, i, "x") for i, t in enumerate(texts)] + [(None, texts[0], -1, "y"), (None, None, 50, None), (None, "", 51, None), (None, "some words of its own that nobody else here has", 52, "z"), (4, "a text with an id that stands by itself in here", 53, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_id long, place string")
    out = corpus_pipeline.unique(spark, df, None)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    groups = {}
    for (i, t), g in plain_groups([(i, t) for i, (_, t, _, _) in enumerate(rows[:-1])]).items():
        groups.setdefault(g, set()).add(t)
    assert 4 < len(groups) < 30
    kept = {min(g, key=hashes.get) for g in groups.values()}
    assert sorted((r[1] for r in got if r[0] is None), key=str) == sorted(kept, key=str)
    assert set(got) <= set(rows) and rows[-1] in got
