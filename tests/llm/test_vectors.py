"""Operators 4 and 10 against all pairs."""

import math

import numpy as np
import pytest

from costdocs.llm import graph_search, voronoi

ODD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0], [1.0], [3.0, -1.0, 0.5, 7.0]]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b") for i, v in rows], "vec_id long, embedding array<double>, label int, v string, shard string")


def usable(rows, nonzero):
    return [(i, v) for i, v in rows if not (i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or nonzero and not any(v))]


def sample(seed, count, size, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=size).tolist()) for i in range(count)]
    same = rng.normal(size=size).tolist()
    return rows + [(count + i, same) for i in range(copies)]


def exact(rows, every, k, scale):
    """By query id: (rank, id, score) of all its rows' hits."""
    found = {}
    for n, (q, a) in enumerate(rows):
        if q % every == 0:
            scores = sorted((-sum(scale(x) * scale(y) for x, y in zip(a, b)), i) for m, (i, b) in enumerate(rows) if m != n)
            found.setdefault(q, []).extend((r, i, -s) for r, (s, i) in enumerate(scores[:k], 1))
    return {q: sorted(hits) for q, hits in found.items()}


def by_query(rows):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(hits) for q, hits in found.items()}


def hits_of(rows):
    return {q: [hit[1:] for hit in hits] for q, hits in by_query(rows).items()}


@pytest.mark.parametrize("options", [{}, {"pivot_count": 5, "group_queries": 3, "chunk_rows": 40}])
def test_voronoi_join_is_exact(spark, options):
    rows = sample(1, 400, 6, copies=150) + [(1000 + i, v) for i, v in enumerate(ODD)] + [(None, [1.0] * 6), (7, [0.0] * 6), (20, sample(1, 21, 6)[20][1])]
    rows += [(30, v) for _, v in sample(2, 40, 6)]  # one id, many vectors
    got = by_query(voronoi.voronoi_top_k(table(spark, rows), 10, 7, **options).collect())
    assert got == exact(usable(rows, False), 10, 7, lambda x: math.floor(1024 * x))


def test_voronoi_join_leaves_out_what_cannot_matter(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (10.0 * (1 + i % 4) * np.eye(4)[i % 4] + 0.01 * rng.normal(size=4)).tolist()) for i in range(400)]
    vectors = table(spark, rows)
    assert by_query(voronoi.voronoi_top_k(vectors, 40, 5, pivot_count=16, group_queries=2).collect()) == exact(usable(rows, False), 40, 5, lambda x: math.floor(1024 * x))


def test_very_large_components(spark):
    rows = [(i, [1e12 + i, 1.0, -3.0 * i]) for i in range(12)] + [(50, [1e300, 0.0, 0.0])]
    got = hits_of(voronoi.voronoi_top_k(table(spark, rows), 5, 3).collect())
    limit = 2**63 - 1
    rows = dict(usable(rows, False))
    for q, hits in got.items():
        scores = {i: min(limit, sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(rows[q], v))) for i, v in rows.items() if i != q}
        assert hits == [(i, s) for s, i in sorted((-s, i) for i, s in scores.items())[:3]] or hits == [(i, -s) for s, i in sorted((-s, i) for i, s in scores.items())[:3]]


def test_few_and_no_vectors(spark):
    for search in (lambda v: voronoi.voronoi_top_k(v, 1, 3), lambda v: graph_search.nearest(v, 1, 3)):
        assert search(table(spark, [])).collect() == []
        assert search(table(spark, [(1, [1.0, 2.0])])).collect() == []
        assert [len(h) for h in by_query(search(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])).collect()).values()] == [1, 1]


def unit(v):
    v = np.array(v, float)
    return v / np.linalg.norm(v)


def test_graph_search_finds_the_nearest(spark):
    rows = sample(5, 900, 16, copies=300) + [(2000 + i, v) for i, v in enumerate(ODD)]
    form = graph_search.Graphs(shard_rows=300, degree=16, beam=32, wide_beam=96)
    got = hits_of(graph_search.nearest(table(spark, rows), 25, 5, form).collect())
    width = max(len(v) for _, v in usable(rows, True))
    vectors = {i: np.pad(np.array(v, float), (0, width - len(v))) for i, v in usable(rows, True)}
    units = {i: unit(v) for i, v in vectors.items()}
    hit = total = 0
    for q, a in units.items():
        if q % 25 == 0:
            best = sorted((-float(a @ b), i) for i, b in units.items() if i != q)
            border = -best[4][0]
            assert len(got[q]) == 5 and q not in [i for i, _ in got[q]]
            for i, s in got[q]:
                assert s == pytest.approx(float(a @ units[i]), abs=1e-12)
            hit += sum(s >= border - 1e-12 for _, s in got[q])
            total += 5
    assert hit / total >= 0.95
    assert [i for i, _ in got[900]] == [901, 902, 903, 904, 905]  # equal vectors: smaller ids first


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (7, [1.0, 0.1]), (9, [0.1, 1.0]), (9, [1.0, 0.0])]
    got = sorted(map(tuple, graph_search.nearest(table(spark, rows), 5, 2).select("rank", "vec_id").collect()))
    assert got == [(1, 0), (1, 0), (1, 9), (2, 7), (2, 9), (2, 9)]
    exactly = by_query(voronoi.voronoi_top_k(table(spark, rows), 5, 2).collect())
    assert exactly == exact(rows, 5, 2, lambda x: math.floor(1024 * x))


def test_queries_are_not_copied_to_chunks(spark):
    plan = voronoi.voronoi_top_k(table(spark, sample(4, 60, 4)), 10, 3, chunk_rows=10)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "CoGroup" not in plan


def test_pruning_keeps_diverse_edges():
    angles = np.array([0.0, 0.1, 0.11, 0.12, -0.2])
    units = np.stack([np.cos(angles), np.sin(angles)], 1).astype(np.float32)
    kept = graph_search.robust_prune(units, np.array([0]), np.array([[1, 2, 3, 4, 1]]), 4, 1.2)
    assert sorted(kept[0].tolist()) == [-1, -1, 1, 4]


@pytest.mark.parametrize("clusters", [4, 300])
def test_clusters_do_not_part_the_graph_of_a_shard(spark, clusters):
    rng = np.random.default_rng(clusters)
    vectors = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 3000)] + 0.1 * rng.normal(size=(3000, 64))
    got = hits_of(graph_search.nearest(table(spark, list(enumerate(vectors.tolist()))), 20, 5).collect())
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = units @ units.T
    np.fill_diagonal(scores, -2)
    hit = [s >= np.sort(scores[q])[-5] - 1e-9 for q, hits in got.items() for _, s in hits]
    assert len(hit) == 150 * 5 and sum(hit) >= 0.98 * len(hit)


def test_every_node_is_reached():
    units = np.eye(12, dtype=np.float32)
    edges = np.where(np.arange(12)[:, None] < 6, np.arange(1, 13)[:, None] % 6, np.full((12, 1), -1))
    assert graph_search.reached(edges, np.array([0])).sum() == 6
    assert graph_search.reached(graph_search._linked(units, edges, np.array([0])), np.array([0])).all()
