import numpy as np

from stemspark.operators import cluster, graph, grid, peel
from stemspark.params import Stem


def test_voxels_unpack_and_count(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.4, 0.0, 0.0), (2, 1.2, 0.0, 3.0), (3, float("nan"), 0.0, 0.0)], "point_id long, x double, y double, z double")
    placed = grid.cells(grid.finite(points), 0.5, 0.5)
    rows = {r["voxel_key"]: r for r in grid.voxels(placed).collect()}
    assert sorted(r["n"] for r in rows.values()) == [1, 2]
    back = placed.select("ix", "iy", "iz", *[c.alias(f"u{i}") for i, c in enumerate(grid.unpacked(placed["voxel_key"]))]).collect()
    assert all((r["ix"], r["iy"], r["iz"]) == (r["u0"], r["u1"], r["u2"]) for r in back)
    assert grid.voxels(grid.cells(points.limit(0), 0.5, 0.5)).count() == 0


def test_components_of_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {*range(41), *range(100, 120), 200, 201, 202}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 120)} == {100} and got[202] == 200


def test_lattice_clusters(spark):
    xs = [0.05, 0.16, 0.27, 5.05]
    points = spark.createDataFrame([(i, x, 0.05, 0.05) for i, x in enumerate(xs)], "point_id long, x double, y double, z double")
    cells = grid.voxels(grid.cells(points, 0.1, 0.1))
    assert len(cluster.offsets(0.1, 0.1)) == 13
    labels = sorted(r["label"] for r in cluster.dbscan(cells, 0.1, 0.1).collect())
    assert labels == [-1, 0, 0, 0]
    assert sorted(r["label"] for r in cluster.dbscan(cells, 0.1, 0.1, 3).collect()) == [-1, 1, 1, 1]


def test_verticality_against_numpy(spark):
    rng = np.random.default_rng(1)
    xyz = rng.random((60, 3))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    cells = grid.voxels(grid.cells(points, 0.05, 0.05))
    got = {r["voxel_key"]: r["verticality"] for r in peel.verticality(cells, 0.4, 0.05, 0.05).collect()}
    rows = cells.collect()
    centres = np.array([[r["x"], r["y"], r["z"]] for r in rows])
    for r, c in zip(rows, centres, strict=True):
        near = centres[((centres - c) ** 2).sum(1) < 0.16]
        want = 0.0 if len(near) < 3 else 1 - abs(np.linalg.eigh(np.cov(near.T, bias=True))[1][2, 0])
        assert abs(got[r["voxel_key"]] - want) < 1e-6


def test_breast_height_section():
    assert Stem().sections == 123 and Stem().breast_section == 5
