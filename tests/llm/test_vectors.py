"""Embedding near-duplicates and the forest, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import ann, embed_dedup

KINDS = {"float": "array<float>", "double": "array<double>"}


def table(spark, kind="float", seed=1, near=40, copies=12, others=120, dim=24):
    """Vectors with groups of near and exact copies, odd ones, and repeated ids; labels 0 and 1, one null."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((others, dim))
    cloud = rng.standard_normal(dim) + 0.05 * rng.standard_normal((near, dim))
    chain = [rng.standard_normal(dim)]
    for _ in range(15):
        chain.append(chain[-1] + 0.18 * np.linalg.norm(chain[-1]) * (lambda g: g / np.linalg.norm(g))(rng.standard_normal(dim)))
    vectors = [*base, *cloud, *np.array(chain), *[base[0]] * copies, *(3 * base[:5])]
    rows = [(i, [float(np.float32(c)) for c in v], i % 2 if i < others else 0, 7) for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] + [1.0] * (dim - 1), 0), (n + 3, [None] + [1.0] * (dim - 1), 0), (n + 4, rows[0][1], None),
           (n + 5, [float("inf")] + [1.0] * (dim - 1), 0), (n + 6, [1.0] * 3, 0), (None, rows[0][1], 0), (n + 7, [], 0), (5, rows[1][1], 1), (5, rows[0][1], 0)]
    return spark.createDataFrame([*rows, *[(*o, 7) for o in odd]], f"vec_id long, embedding {KINDS[kind]}, label int, node int").cache()


def good(r, dim=24):
    v = r.embedding
    return r.vec_id is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_duplicates(spark, kind, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    df = table(spark, kind)
    rows = df.collect()
    unit = [np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) if good(r) else None for r in rows]
    linked = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i].label is not None and rows[i].label == rows[j].label and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    least = [r.vec_id for r in rows]
    while True:
        new = [min([least[i], *[least[j] for j in linked[i]]], key=lambda x: (x is None, x)) for i in range(len(rows))]
        if new == least:
            break
        least = new
    want = sorted(((r.vec_id, len(linked[i]), least[i]) for i, r in enumerate(rows)), key=repr)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()), key=repr)
    assert got == want


def test_no_vectors(spark):
    empty = table(spark).where("false")
    assert embed_dedup.near_duplicates(empty).collect() == []
    assert ann.search(empty, F.col("vec_id") % 100 == 0).collect() == []
    odd = table(spark).where("label is null or vec_id is null")
    assert all(r.n_links == 0 for r in embed_dedup.near_duplicates(odd).collect())


def test_estimates_are_unbiased_and_bounds_hold():
    dim, rng = 64, np.random.default_rng(4)
    turn = embed_dedup.rotation(dim, 5)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((400, dim)), rng.standard_normal((400, dim))))
    y = 0.9 * x + 0.4 * y
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    sign, factor = np.where(x @ turn > 0, 1.0, -1.0), np.abs(x @ turn).sum(axis=1) / math.sqrt(dim)
    upper = embed_dedup.bounds(sign, factor, y @ turn, dim)
    lower = 2 * embed_dedup.bounds(sign, factor, y @ turn, dim, 0.0) - upper
    true = x @ y.T
    assert (true <= upper).all() and (true >= lower).all()
    assert abs((embed_dedup.bounds(sign, factor, y @ turn, dim, 0.0) - true).mean()) < 0.003


def test_enough_tables():
    for bits in (8, 16, 24):
        hit = (1 - math.acos(0.98) / math.pi) ** bits
        assert 1 - (1 - hit) ** embed_dedup.tables_for(bits) >= 0.99999


@pytest.mark.parametrize("candidates", [None, 150])
def test_nearest(spark, candidates):
    df = table(spark, others=400)
    rows = [r for r in df.collect() if good(r)]
    x = np.array([r.embedding for r in rows], float)
    got: dict = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0, candidates=candidates).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = total = 0
    for i, r in enumerate(rows):
        if r.vec_id % 20:
            continue
        away = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        best = sorted((away[j], rows[j].vec_id) for j in range(len(rows)) if rows[j].vec_id != r.vec_id)[:10]
        assert len(got[r.vec_id]) == 10 and got[r.vec_id] == sorted(got[r.vec_id])
        hits += len({k for _, k in best} & {k for _, k in got[r.vec_id]})
        total += 10
    assert hits >= (0.999 if candidates is None else 0.5) * total


def test_fewer_than_asked_for(spark):
    df = table(spark).where("vec_id < 4")
    rows = ann.search(df, F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.query_id) for r in rows) == [(1, 0), (2, 0), (3, 0)]


def recall(spark, x, each, k=10):
    """Share of the true nearest of every ``each``-th vector that the forest finds."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % each == 0, k=k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[i] & set(np.argsort(np.where(np.arange(len(x)) == i, np.inf, ((x - x[i]) ** 2).sum(axis=1)))[:k].tolist())) for i in range(0, len(x), each)]
    return sum(hits) / (k * len(hits))


def test_candidates_follow_the_measured_recall(spark, monkeypatch):
    """With a formula that asks for far too few, candidates are as many as the sampled queries need."""
    monkeypatch.setattr(ann, "LEAST", 20)
    monkeypatch.setattr(ann, "CANDIDATES", 0.1)
    asked, plain = [], getattr(ann, "candidates_needed", None)
    monkeypatch.setattr(ann, "candidates_needed", lambda *a: asked.append(plain(*a)) or asked[-1], raising=False)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((150, 24))
    x = np.repeat(centres, 40, axis=0) + 0.3 * rng.standard_normal((6000, 24))
    assert recall(spark, x, 60) >= 0.9
    assert 20 < asked[0] < 0.5 * len(x)


def test_runs_go_on_in_other_ranges(spark, monkeypatch):
    """Near copies with equal strings in all trees, more than a range holds, further apart than 24 and than a border."""
    for name in ("RANGE_ROWS", "THIN_ROWS", "FULL_ROWS"):
        monkeypatch.setattr(ann, name, 100, raising=False)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((600, 24)), 3 + 1e-7 * rng.standard_normal((900, 24))])
    assert recall(spark, x, 50) == 1


def test_text_ids(spark):
    rows = [(f"v{i:02d}", [float(i % 5 + 1), float(i % 3), 1.0], 1) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int")
    groups = {r.vec_id: r.component_id for r in embed_dedup.near_duplicates(df).collect()}
    assert len(groups) == 30 and groups["v15"] == groups["v00"] == "v00"
    near = ann.search(df, F.col("vec_id") == "v00", k=2).orderBy("rank").collect()
    assert len(near) == 2 and (near[0].query_id, near[0].vec_id, near[0].score) == ("v00", "v15", 0.0)
