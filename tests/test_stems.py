from pathlib import Path

import numpy as np
import pytest

from stemspark.functions import geometry
from stemspark.operators import ground, location, peel, sections, tiles, trees
from stemspark.params import FEW_SECTORS, INNER_POINTS, NOT_ENOUGH_POINTS, RUN_INVALID, RUN_NO_CLUSTERS, SUCCESS, TILT_OUTLIER, TOO_LARGE, TOO_SMALL, Ground, Params, Stem
from stemspark.plans import queries, run, stem_queries
from stemspark.sources import points
from stemspark.storage import numbered, scratch


def ring(n=200, r=0.2, cx=3.0, cy=-1.0, part=1.0):
    a = np.arange(n) * 2 * np.pi * part / n
    return cx + r * np.cos(a), cy + r * np.sin(a)


def test_circle_of_exact_noisy_and_equal_points():
    x, y = ring()
    assert np.allclose(geometry.refined(x, y, geometry.taubin(x, y)), (3.0, -1.0, 0.2))
    rng = np.random.default_rng(3)
    x, y = x + rng.normal(0, 0.002, 200), y + rng.normal(0, 0.002, 200)
    x[:5] += 3
    assert np.allclose(geometry.refined(x, y, (3.0, -1.0, 0.25)), (3.0, -1.0, 0.2), atol=0.03)
    assert geometry.taubin(np.ones(5), np.ones(5)) == (1.0, 1.0, 0.0)


def test_states_come_in_order():
    stem = Stem()
    assert sections.judged(*ring(), stem)[3] == SUCCESS
    assert sections.judged(*ring(r=0.02), stem)[3] == TOO_SMALL
    assert sections.judged(*ring(r=0.8), stem)[3] == TOO_LARGE
    assert sections.judged(*ring(part=0.4), stem)[3] == FEW_SECTORS
    x, y = ring()
    full = sections.judged(np.append(x, np.full(9, 3.0)), np.append(y, np.full(9, -1.0)), stem)
    assert full[3] == INNER_POINTS and full[5] == 9


def test_largest_linked_against_all_pairs():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 120):
        xy = rng.random((n, 2)).round(2)
        near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= 0.1**2
        label = np.arange(n)
        for _ in range(n):
            label = np.where(near, label[None], n).min(1)
        size = np.bincount(label, minlength=n)
        assert geometry.largest_linked(xy, 0.1).sum() == size.max()


def test_sections_overlap_and_empty(spark):
    x, y = ring(100)
    rows = [(1, float(a), float(b), 1.32) for a, b in zip(x, y)] + [(None, 0.0, 0.0, 1.32), (-1, 0.0, 0.0, 1.32), (1, 0.0, 0.0, None)]
    cloud = spark.createDataFrame(rows, "stem_id long, x double, y double, z0 double")
    trees = spark.createDataFrame([(1,), (2,)], "stem_id long")
    got = {(r["stem_id"], r["section_id"]): r for r in sections.extract(cloud, trees, Stem()).collect()}
    assert len(got) == 2 * 123 and got[1, 5]["status"] == SUCCESS and abs(got[1, 5]["radius"] - 0.2) < 1e-6
    assert {r["status"] for k, r in got.items() if k != (1, 5)} == {NOT_ENOUGH_POINTS}
    wide = sections.slices(cloud, Stem(thickness=0.45)).groupBy("section_id").count().collect()
    assert sorted(r["section_id"] for r in wide) == [3, 4, 5]
    assert sections.extract(cloud, trees.limit(0), Stem()).count() == 0


def test_diameter_decisions(spark):
    def row(tree, section, radius, status, sectors=1.0):
        return (tree, section, 0.3 + section * 0.2, 1.0, 2.0, radius, status, sectors, 0.0)

    rows = [row(1, 5, 0.2, 0), row(2, 5, 0.2, 1), row(2, 4, 0.205, 2), row(3, 3, 0.2, 1), row(3, 4, 0.2, 4), row(3, 7, 0.5, 0), row(4, 7, 0.3, 0), row(4, 5, 0.1, 1), row(5, 5, 0.2, -1), row(6, 5, 0.0, 2), row(6, 4, 0.0, 2)]
    found = spark.createDataFrame(rows, "stem_id long, section_id int, z0 double, cx double, cy double, radius double, status int, sector_percentage double, outlier_probability double")
    trees = spark.createDataFrame([(i, 7.0, 8.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.5) for i in range(1, 8)], "stem_id long, cx double, cy double, cz double, ux double, uy double, uz double, deviation_deg double, height_difference double")
    got = {r["stem_id"]: r for r in location.located(found, trees, Stem()).collect()}
    assert [got[i]["dbh_source"] for i in range(1, 8)] == [0, 1, 2, 3, -1, -1, -1]
    assert got[3]["dbh"] == pytest.approx(0.4) and got[4]["dbh"] == pytest.approx(0.6) and got[7]["dbh"] == 0
    assert (got[1]["loc_x"], got[1]["loc_z"]) == pytest.approx((1.0, 1.8)) and (got[7]["loc_x"], got[7]["loc_z"]) == pytest.approx((7.0, 1.8))


def test_pair_with_more_good_sections_is_chosen(spark):
    """Pairs (3, 4) and (6, 7) are equally far from breast height: good sections count, not their sectors."""
    rows = [(1, s, 0.3 + s * 0.25, 0.0, 0.0, r, status, share) for s, r, status, share in ((3, 0.2, 0, 0.1), (4, 0.2, 0, 0.1), (6, 0.3, 2, 1.0), (7, 0.3, 2, 1.0), (5, 0.5, -1, 0.0))]
    rows = [(*r[:2], abs(r[1] - 5) * (0.25 if r[1] > 5 else -0.25) + 1.3, *r[3:]) for r in rows]
    found = spark.createDataFrame(rows, "stem_id long, section_id int, z0 double, cx double, cy double, radius double, status int, sector_percentage double")
    trees = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.5)], "stem_id long, cx double, cy double, cz double, ux double, uy double, uz double, deviation_deg double, height_difference double")
    assert location.located(found, trees, Stem()).first()["dbh"] == pytest.approx(0.4)


def test_given_heights_and_invalid_input(spark):
    cloud = spark.createDataFrame([(i, float(i), 0.5, 3.0, z0) for i, z0 in enumerate((0.1, 0.2, 1.0, 2.0, 3.0, 4.0))], "point_id long, x double, y double, z double, z0 double")
    size = run.plot_size(cloud, True).first()
    assert (size["num_points"], size["area_m2"]) == (6, 2)
    assert run.run_inventory(cloud.drop("x")).status == RUN_INVALID and run.run_inventory(cloud.limit(0)).status == RUN_INVALID
    # Without the column heights are worked out, and there are no stems.
    out = run.run_inventory(cloud.drop("z0"), Params(normalise_heights=False))
    assert out.status == RUN_NO_CLUSTERS and out.terrain is not None and "heights" in out.seconds


def test_tiles_join_clusters_and_fill_slopes(spark):
    """A line of cells over many tiles is one cluster; a cell two steps off is another's; cloths follow a step slope."""
    n = 3 * tiles.SIDE
    cells = [(i, i, 5, 5) for i in range(n)] + [(n + 1 + i, i, 9, 5) for i in range(n)]
    found = spark.createDataFrame(cells, "voxel_key long, ix long, iy long, iz long")
    labels = {r["voxel_key"]: r["label"] for r in tiles.clusters(found, 0.1, 0.1, 0.1 * 3**0.5 + 1e-6, 2).collect()}
    assert {labels[i] for i in range(n)} == {0} and {labels[n + 1 + i] for i in range(n)} == {n + 1}
    floor = np.repeat(np.linspace(0, 5, 40)[None], 40, 0)
    free = np.ones((40, 40), bool)
    free[:, :5] = False
    cloth = np.where(free, floor + 0.2, floor)
    assert np.allclose(ground.sloped(cloth, floor, free), floor) and np.allclose(ground.sloped(cloth[:6, 4:10], floor[:6, 4:10], free[:6, 4:10]), cloth[:6, 4:10])


def test_ranks_over_ranges(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 100003 AS k")
    got = [r["n"] for r in numbered(rows, "k", "n").orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_terrain_of_a_plane(spark):
    xy = [(i * 0.3, j * 0.3) for i in range(40) for j in range(40)]
    cloud = spark.createDataFrame([(k, x, y, 0.02 * x) for k, (x, y) in enumerate(xy)], "point_id long, x double, y double, z double")
    nodes = ground.terrain(cloud, Ground())
    heights = [r["z0"] for r in ground.normalised(cloud, nodes, 0.45).collect()]
    assert len(heights) == 1600 and np.median(np.abs(heights)) < 0.02
    assert nodes.where("is_valid").count() < nodes.count()
    with pytest.raises(ground.TooSmall):
        ground.terrain(cloud.limit(2), Ground())


def test_mesh_keeps_triangles_of_valid_nodes(spark):
    nodes = spark.createDataFrame([(i, i != 4) for i in range(9)], "node_id long, is_valid boolean")
    triangles = ground.mesh(spark, 3, 3)
    assert triangles.count() == 8 and ground.valid_mesh(triangles, nodes).count() == 2
    assert ground.mesh(spark, 1, 5).count() == 0


def test_sources(spark, tmp_path):
    assert points.from_buffer(spark, np.arange(8.0)).count() == 2
    (tmp_path / "a.xyz").write_text("1 2 3\nbad 2 3\n")
    assert sorted(str(r["x"]) for r in points.from_text(spark, str(tmp_path / "a.xyz")).collect()) == ["1.0", "None"]
    table = spark.createDataFrame([(1, 2, 3, 4.0)], "x int, y int, z int, Z0 double")
    assert points.height_columns(table)[1] == "Z0"
    assert points.from_table(table, z0="Z0").columns == ["point_id", "x", "y", "z", "z0"]
    with pytest.raises(ValueError):
        points.from_table(table, x="nope")


def _orders(spark, tmp_path, tree: int, trees: int) -> str:
    """The orders of one tree of a plot of 2,400, as the last of so many trees; the others' are some others."""
    keys = [tree + 2400 * j for j in range(375)] + [10 * j + k for k in range(trees - 1) for j in range(375)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_sections_of_a_large_plot_reach_all_sectors(spark, tmp_path):
    rows = stem_queries.section_circles(spark, _orders(spark, tmp_path, 1200, 1)).collect()
    assert len(rows) == 29
    assert {(r["status"], r["sectors"], r["fits"]) for r in rows} == {(0, 16, True)}


def test_stems_of_a_large_plot_stay_whole(spark, tmp_path):
    rows = queries.inventory_trees(spark, _orders(spark, tmp_path, 989, 10)).collect()
    assert len(rows) == 10
    assert all(r["whole"] for r in rows)


def test_a_run_on_a_large_plot_gives_a_row_a_tree(spark, tmp_path):
    rows = stem_queries.inventory_run(spark, _orders(spark, tmp_path, 989, 10)).collect()
    assert len(rows) == 10
    assert {(r["dbh_source"], r["height"], r["axis_valid"]) for r in rows} == {(0, 6, True)}


def test_no_section_of_a_swept_stem_is_voted_out(spark, tmp_path):
    sf = _orders(spark, tmp_path, 989, 10)
    states = []
    for sweep in (0.0, 0.001):
        sliced = sections.slices(queries.forest(spark, sf, even=True, sweep=sweep).where("z0 > 0").withColumnRenamed("t", "stem_id"), Stem())
        found = sections.circles(sliced, Stem()).withColumn("z0", sections.heights(Stem())).localCheckpoint()
        states.append({r["status"] for r in sections.voted(found, Stem()).select("status").collect()})
    assert states == [{SUCCESS, TILT_OUTLIER}, {SUCCESS}]


def test_trees_leave_little_on_disk(spark, tmp_path):
    """Points are worked out again where they are needed, not stored: 240,000 of them left 25 MB and more."""
    sf, root = _orders(spark, tmp_path, 989, 10), Path(scratch(spark, "none").removeprefix("file://")).parent
    before = set(root.rglob("*"))
    assert len(queries.inventory_trees(spark, sf).collect()) == 10
    assert sum(p.stat().st_size for p in set(root.rglob("*")) - before if p.is_file()) < 2_000_000


def test_neighbourhoods_are_summed_by_columns():
    """The same sums as cell by cell, and the same verdicts as from eigenvectors."""
    rng = np.random.default_rng(2)
    a, z = rng.random(6000) * 2 * np.pi, rng.integers(0, 64, 6000)
    at = np.unique(np.stack([(32 + 8 * np.cos(a)).astype(int), (32 + 8 * np.sin(a)).astype(int), z], 1), axis=0)
    at = np.unique(np.concatenate([at, rng.integers(0, 64, (500, 3))]), axis=0)
    block, offsets = tiles.Block(np.arange(len(at)), at, 7, 64), tiles.ball(0.1, 0.02, 0.02)
    rows = np.arange(len(at))
    got = block.moments(rows, offsets)
    assert (got == block._moments_by_cell(rows, np.array(offsets), block.table(rows) >= 0)).all()
    for threshold in (0.3, 0.7, 0.9):
        assert (tiles.upright(got, 0.02, 0.02, threshold) == (tiles.normals(got, 0.02, 0.02)[0] > threshold)).all()


def test_joins_give_what_labels_and_trees_everywhere_give(spark, tmp_path, monkeypatch):
    sf = _orders(spark, tmp_path, 989, 3)
    got = []
    for everywhere in (None, 0):
        if everywhere is not None:
            monkeypatch.setattr(tiles, "EVERYWHERE", everywhere)
            monkeypatch.setattr(trees, "EVERYWHERE", everywhere)
        cloud = queries.forest(spark, sf, even=True).where("z0 < 2")
        stems = peel.peel(cloud, Params().stripe)
        placed, _ = trees.individualised(cloud, stems.frame(), Params())
        rows = placed.frame().join(stems.frame().select("point_id", "stem_id"), "point_id", "left").selectExpr("point_id", "stem_id", "tree_id", "round(axis_distance, 9) AS d")
        got.append(sorted((tuple(r) for r in rows.collect()), key=str))
    assert got[0] == got[1] and len({r[1] for r in got[0]}) > 3
