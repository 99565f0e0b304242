"""Embedding near-dedup, held against brute force."""

import numpy as np
import pytest


@pytest.fixture(scope="module")
def vectors():
    """Vectors in all directions, each with a partner near the threshold of 0.95."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9505, 0.96, (len(x), 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])


def links(x):
    s = x @ x.T
    return (s >= 0.95).sum(1) - 1


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def found(out, n):
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    return np.array([got[k] for k in range(n)])


def test_many_centroids_lose_no_links(spark, vectors):
    from panelspark.llm.vector_graph import link

    got, want = found(link(frame(spark, vectors), sample=600, per_centroid=10), len(vectors)), links(vectors)
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_the_widest_margin_is_exact(vectors):
    from panelspark.llm.vector_graph import shards_of, spherical_kmeans, widest

    held = [set(m.tolist()) for m in shards_of(vectors, spherical_kmeans(vectors, 100), widest(0.95))]
    assert all(held[k] & held[k + 2500] for k in range(2500)) and sum(map(len, held)) < 100 * len(held)


def test_links_lost_between_shards_are_found_again(spark, vectors, monkeypatch):
    from panelspark.llm import vector_graph

    monkeypatch.setattr(vector_graph, "MARGINS", (0.0, 0.0))  # a margin that is too small, and no wider one to take
    got = found(vector_graph.link(frame(spark, vectors), sample=600, per_centroid=50), len(vectors))
    assert (got == links(vectors)).all()


def test_links_lost_in_a_shard_are_found_again(vectors, monkeypatch):
    from panelspark.llm import vector_graph

    x = np.concatenate([vectors[:1200], vectors[2507:2509]])  # two links, both of nodes that even spacing passes by
    lists = vector_graph.build(x)
    assert len(vector_graph.linked_probes(x, lists, 0.95)) == 4
    monkeypatch.setattr(vector_graph, "range_search", lambda x, *_: iter([(np.zeros(0, np.int64), np.zeros(0, np.int64))]))
    q, v = vector_graph.audited_search(x, lists, 0.95)
    assert set(zip(q.tolist(), v.tolist())) == {(7, 1200), (1200, 7), (8, 1201), (1201, 8)}


def test_vectors_of_every_length_are_linked(spark, vectors):
    from panelspark.llm.vector_graph import link

    short = np.eye(5)[[0, 1, 0, 2]] + [[0, 0.1, 0, 0, 0], [0] * 5, [0] * 5, [0] * 5]
    rows = [v.tolist() for v in vectors[:60]] + [v.tolist() for v in short] + [[1.0], [3.0], [], None, [0.0, 0.0], [None, 1.0]]
    data = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    for shard in (3000, 3):  # by exact blocks, or each length by its own graph
        got = {r["vec_id"]: r for r in link(data, shard=shard).collect()}
        assert [got[k]["n_links"] for k in range(60, 70)] == [1, 0, 1, 0, 1, 1, 0, 0, 0, 0]
        assert [got[k]["component_id"] for k in range(60, 70)] == [60, 61, 60, 63, 64, 64, 66, 67, 68, 69]
        assert sum(got[k]["n_links"] for k in range(60)) == 0
    assert link(data.limit(0)).count() == 0 and link(data.where("vec_id > 65")).count() == 4


def test_a_hot_shard_dealt_by_parts_loses_no_links(spark, vectors):
    from panelspark.llm.vector_graph import link

    rng = np.random.default_rng(4)
    x = np.concatenate([vectors[:1] + rng.normal(0, 0.028, (300, 64)), vectors[2000:3000]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (found(link(frame(spark, x), shard=120), len(x)) == links(x)).mean() > 0.97
