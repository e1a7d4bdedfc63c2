import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.operators import graph, neighbours, spectral, tower
from stridemill.operators.components import connected_components
from stridemill.operators.kmeans import kmeans
from stridemill.plans import fixtures as fx
from stridemill.plans import mining
from stridemill.scale import checkpoint

SF = "/root/testdata/sf0.001"


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_nearest_with_copies(spark, block_rows):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(150, 4))
    vectors[::3] = vectors[0]  # a third of all rows are copies
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.maximum(np.round(unit @ unit.T, 12), 0)
    for i in range(0, 150, 3):
        sims[i, ::3] = 1.0
    expected = set()
    for i in range(150):
        order = [j for j in np.lexsort((np.arange(150), -sims[i])) if j != i][:5]
        expected |= {(i, int(j)) for j in order}
    got = {(r["src"], r["dst"]) for r in neighbours.nearest(frame(spark, vectors), 5, block_rows).collect()}
    assert got == expected


def clustered(rng, size, centres, width=0.05, dim=12):
    return rng.normal(size=(centres, dim))[rng.integers(0, centres, size)] + rng.normal(scale=width, size=(size, dim))


@pytest.mark.parametrize(("cells", "spread"), [(1, "everywhere"), (8, "clusters"), (64, "everywhere")])
def test_nearest_is_exact_for_any_number_of_cells(spark, cells, spread):
    rng = np.random.default_rng(cells)
    vectors = clustered(rng, 600, 20) if spread == "clusters" else rng.normal(size=(600, 12))
    vectors[5] = 0.0
    report = {}
    got = neighbours.nearest(frame(spark, vectors), 4, 32, cells, (2, 5), report).collect()
    vectors[5, 0] = 1e-300
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    sims = np.maximum(np.round(unit @ unit.T, 12), 0)
    np.fill_diagonal(sims, -1)
    expected = {(i, int(j)) for i in range(600) for j in np.lexsort((np.arange(600), -sims[i]))[:4]}
    assert {(r["src"], r["dst"]) for r in got} == expected and len(got) == 2400
    assert report["rows"] == 600 and report["cells"] == cells


def test_visited_cells_per_row_stay_flat_as_rows_grow(spark):
    copies = []
    for size in (500, 5_000):
        report = {}
        vectors = clustered(np.random.default_rng(3), size, size // 50, 0.02)
        found = neighbours.nearest(frame(spark, vectors), 3, 64, report=report)
        assert found.count() == 3 * size
        copies.append(report["copies_per_row"])
        assert report["cells"] == int(size**0.5)
    assert copies[1] <= 1.5 * copies[0] + 1


def test_forest_labels_are_smallest_members():
    rng = np.random.default_rng(4)
    for size in (1, 30, 500):
        a, b = rng.integers(0, size, (2, size // 2 + 1))
        label = np.arange(size)
        for _ in range(size):
            for x, y in zip(a, b, strict=True):
                label[[x, y]] = min(label[x], label[y])
        assert (neighbours._components(size, a, b) == label).all()


def test_nearest_falls_back_to_smallest_ids(spark):
    got = neighbours.nearest(frame(spark, np.eye(5)), 2).orderBy("src", "dst").collect()
    assert [(r["src"], r["dst"]) for r in got] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)]


def test_similar_links_span_components(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    vectors = np.repeat(centres, 20, axis=0) + rng.normal(scale=0.02, size=(120, 8))
    vectors[::3] = vectors[0]
    rows = frame(spark, vectors).withColumn("level", F.lit("low"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.985
    label = np.arange(120)
    for _ in range(120):
        label = np.where(near, label[None, :], 999).min(axis=1)
    for cells in (1, 20):
        links = checkpoint(neighbours.similar_links(rows, 0.985, "level", 16, cells).filter("a <> b"))
        got = {r["id"]: r["component"] for r in connected_components(links).collect()}
        assert all(got.get(i, i) == label[i] for i in range(120))


def test_eigenvalues_match_dense(spark):
    segs = fx.graph_segments(spark, SF).filter("pos < 60")
    edges = checkpoint(graph.contrastive_edges(graph.affinity_edges(segs), 0.65))
    n = segs.count()
    dense = np.zeros((n, n))
    for r in edges.select("src", "dst", "contrastive").collect():
        dense[r[0], r[1]] = dense[r[1], r[0]] = r[2]
    scale = 1 / np.sqrt(np.maximum(np.abs(dense).sum(1), 1e-12))
    values = np.linalg.eigvalsh(np.eye(n) - dense * scale[:, None] * scale[None, :])[:9]
    found = spectral.bottom_spectrum(segs, edges, 9, slice_edges=6)
    assert np.abs(found.values - values).max() < 1e-6
    side = {r["pos"]: int(r["success"]) for r in segs.select("pos", "success").collect()}
    for r in spectral.spectral_embedding(found, 7).collect():
        assert all(v == 0 for v, (s, _) in zip(r["v"], found.picks[1:7]) if s != side[r["node"]])


def test_cluster_count_and_gap():
    values = [0.0, 0.1, 0.5, 0.6, 1.0]
    assert spectral.choose_cluster_count(values, 5, 2, 4) == 2
    assert spectral.choose_cluster_count(values, 1, 2, 8) == 1
    assert spectral.choose_cluster_count(values, 5, 3, 3) == 3
    assert spectral.eigengap(values, 5) == 0.0


def test_kmeans_finds_separated_groups(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(loc=c, scale=0.05, size=(30, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "node long, v array<double>")
    got = {r["node"]: r["cluster"] for r in kmeans(rows, 3, restarts=4).collect()}
    assert [got[i] for i in range(90)] == [0] * 30 + [1] * 30 + [2] * 30


def test_communities():
    links = {(0, 1): 5.0, (1, 2): 5.0, (0, 2): 5.0, (3, 4): 5.0, (2, 3): 0.5}
    assert tower.greedy_modularity(list(range(5)), links) == [{0, 1, 2}, {3, 4}]
    assert tower.greedy_modularity([0, 1], {}) == [{0}, {1}]


def test_guards(spark):
    segs = fx.graph_segments(spark, SF).filter("pos < 20")
    failed = segs.withColumn("success", F.lit(False))
    edges = graph.contrastive_edges(graph.affinity_edges(failed), 0.65)
    with pytest.raises(graph.NoSuccessError):
        graph.check_contrast(failed, edges)
    with pytest.raises(graph.EmptyContrastError):
        graph.check_contrast(segs, edges.withColumn("contrastive", F.lit(0.0)))
    assert mining.mine_tower(segs.limit(0)).meta == {"segment_count": 0}
    with pytest.raises(ValueError):
        mining.miner("nothing")


def test_communities_by_moves_come_close_to_greedy_ones(spark):
    for seed in (1,):
        rng = np.random.default_rng(seed)
        group = rng.integers(0, 5, 60)
        chance = np.where(group[:, None] == group[None, :], 0.4, 0.03)
        rows = [(a, b, float(rng.integers(1, 5))) for a in range(60) for b in range(60) if a != b and rng.random() < chance[a, b]]
        edges = spark.createDataFrame(rows, "source long, target long, weight double")
        nodes = spark.range(61).withColumnRenamed("id", "key")
        labels = {r["cluster"]: r["community"] for r in tower.communities(spark, nodes, edges, "moves").collect()}
        links = {}
        for a, b, w in rows:
            links[min(a, b), max(a, b)] = links.get((min(a, b), max(a, b)), 0.0) + w
        greedy = {n: i for i, g in enumerate(tower.greedy_modularity(list(range(61)), links)) for n in g}

        def quality(label):
            total = sum(links.values())
            load = {}
            for (a, b), w in links.items():
                for n in (a, b):
                    load[label[n]] = load.get(label[n], 0.0) + w
            return sum(w for (a, b), w in links.items() if label[a] == label[b]) / total - sum((x / (2 * total)) ** 2 for x in load.values())

        assert set(labels) == set(range(61)) and quality(labels) >= 0.95 * quality(greedy)
        assert list(labels.values()).count(labels[60]) == 1


def test_communities_beyond_what_the_driver_merges(spark):
    none = spark.createDataFrame([], "source long, target long, weight double")
    with pytest.raises(ValueError, match="moves"):
        tower.communities(spark, spark.range(2_500), none)
    found = tower.communities(spark, spark.range(2_500).withColumnRenamed("id", "key"), none, "moves")
    assert found.filter("cluster = community").count() == 2_500
