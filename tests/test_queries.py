"""Every query with SQL gives the rows that DuckDB gives; every query runs."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = db.execute(registry.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(repr(tuple(r[i] for i in at)) for r in result.fetchall())


def test_the_others_are_compared_below():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"whitened_score_k2", "control_scores", "sweep_grid", "sweep_best_cell", "quote_grounding", "gate_cost_tally"}


@pytest.fixture(scope="module")
def vectors(db):
    """Vectors, labels, and what numpy makes of them: scores at any k and strength, by the rules of the geometry."""
    rows = db.execute("select vec_id, label, embedding from embeddings order by vec_id").fetchall()
    label, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float32).astype(float)
    l2 = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    poles = {c: [l2(l2(x[label == side]).mean(axis=0)) for side in pair] for c, pair in {"two_worlds": (0, 1), "adaptors": (2, 3), "arbitrariness": (4, 5)}.items()}
    mu = x[::5].mean(axis=0)

    def score(v, k, strength):
        basis = np.linalg.svd(x[::5] - mu, full_matrices=False)[2][:k]
        raw = {c: l2(l2(p - mu) - l2(n - mu)) for c, (p, n) in poles.items()}
        shared = np.linalg.svd(np.stack(list(raw.values())), full_matrices=False)[2][0]
        d = v - mu
        d = l2(d - d @ basis.T @ basis)
        return {c: d @ l2(a - strength * (a @ shared) * shared) for c, a in raw.items()}

    return label, x, score


def test_whitened_scores(spark, sf, vectors):
    _, x, score = vectors
    want = {(f"paper/{p}", c): e.max() for c, s in score(x, 2, 0.5).items() for p, e in enumerate(s.reshape(-1, 5))}
    got = {(r.pdf_path, r.criterion): r.e for r in registry.QUERIES["whitened_score_k2"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_control_scores(spark, sf, vectors):
    label, x, score = vectors
    means = {i: x[label == i].mean(axis=0) for i in set(label.tolist())}
    got = {(r["name"], r.criterion): r.e for r in registry.QUERIES["control_scores"](spark, sf).collect()}
    want = {(f"label {i}", c): e for i, v in means.items() for c, e in score(v, 2, 0.5).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_sweeps(spark, sf, db, vectors):
    _, x, score = vectors
    cells = {(i * 3 + j, k, s): score(x, k, s) for i, k in enumerate((0, 1, 2)) for j, s in enumerate((0.0, 0.5, 1.0))}
    got = {(r.cell, r.k, r.strength, r.criterion): (r.n, r.mean_e) for r in registry.QUERIES["sweep_grid"](spark, sf).collect()}
    for (cell, k, s), by in cells.items():
        for c, e in by.items():
            best = e.reshape(-1, 5).max(axis=1)
            assert got.pop((cell, k, s, c)) == (len(best), pytest.approx(best.mean(), abs=1e-5))
    assert not got
    least = dict(db.execute("select doc_id // 5, min(quality) from labels group by 1").fetchall())
    papers = [p for p in range(len(x) // 5) if p in least]
    rank = lambda v: np.array([(v < a).sum() + (v == a).sum() / 2 for a in v])
    y = rank(np.array([1.0 if least[p] == 1 else 0.0 for p in papers]))
    rho = {(i * 2 + j, c): np.corrcoef(rank(e.reshape(-1, 5).max(axis=1)[papers]), y)[0, 1] for i, k in enumerate((0, 2)) for j, s in enumerate((0.0, 0.5)) for c, e in score(x, k, s).items()}
    for r in registry.QUERIES["sweep_best_cell"](spark, sf).collect():
        assert r.rho == pytest.approx(max(v for (_, c), v in rho.items() if c == r.criterion), abs=1e-5) and rho[r.cell, r.criterion] == pytest.approx(r.rho, abs=1e-5)


def test_grounding_of_every_pair(spark, sf, db):
    from corpusmill.functions import grounding as G

    docs, quotes = db.execute("select doc_id, text from documents").fetchall(), db.execute("select item_id, text from benchmark").fetchall()
    found, tally = {}, Counter()
    for d, text in docs:
        marks, spaces = G.fold_marks(text), G.fold_spaces(text)
        for i, quote in quotes:
            q = G.fold_marks(quote)
            strict = G.fold_spaces(quote) in spaces
            sizes = [len(q)] if q in marks else G.block_sizes(q, marks) if any(q[k : k + 15] in marks for k in range(0, len(q) - 14)) else [0]
            fuzzy = sum(sizes) >= 0.85 * len(q) and max(sizes) >= min(15, len(q))
            if fuzzy:
                found[d, i] = round(sum(sizes) / len(q), 5)
            for model in (str(d % 3), None):
                tally[model, "cells"] += 1
                tally[model, "strict"] += strict
                tally[model, "fuzzy"] += fuzzy
                tally[model, "newly_passes"] += fuzzy and not strict
    assert {(r.doc_id, r.item_id): r.coverage for r in registry.QUERIES["quote_grounding"](spark, sf).collect() if r.grounded} == found
    for r in registry.QUERIES["gate_cost_tally"](spark, sf).collect():
        assert all(r[c] == tally[r.model, c] for c in ("cells", "strict", "fuzzy", "newly_passes"))
