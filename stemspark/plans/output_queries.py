"""Registered queries of what a run gives out: sheets, layers and terrain meshes, on trees and sections derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemspark.operators import grid, trees
from stemspark.params import Draw, Georeference, Params, Stem
from stemspark.plans import exports
from stemspark.plans.queries import _CELLS, _POINTS, points
from stemspark.plans.stem_queries import _D, _L, _SECTIONS, _sections

#: Powers of two, so that both sides divide exactly.
GEO = Georeference(shift_x=10.0, shift_y=-20.0, shift_z=3.0, scale=2.0)
#: Sections of the sheets: S1 to S10.
STEM = Stem(maximum_height=2.35)


def _rounded(*names: str) -> list[Column]:
    return [F.floor(F.col(c) * 10000 + 0.5).cast("long").alias(c.lower()) for c in names]


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree an order, the first three hundred orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey < 300")
    return o.selectExpr(
        "o_orderkey AS stem_id", "CAST(o_orderkey + 1 AS int) AS tree_no", "o_custkey * 0.01D AS cx", "(o_custkey % 100) * 0.1D AS cy", "2D AS cz", "0.5D AS height_difference", "0.6D AS ux", "0D AS uy", "0.8D AS uz",
        "o_orderkey % 4 <> 0 AS axis_valid", "36.8698976D AS deviation_deg", "o_custkey * 0.01D + 3 AS highest_x", "(o_custkey % 100) * 0.1D AS highest_y", "6D AS highest_z", "5.5D AS highest_z0", "true AS height_found",
        "CASE WHEN o_orderkey % 7 = 0 THEN 0D ELSE 0.1D + (o_custkey % 20) * 0.01D END AS dbh", "CAST(o_orderkey % 5 - 1 AS int) AS dbh_source", "o_custkey * 0.01D AS loc_x", "(o_custkey % 100) * 0.1D AS loc_y", "1.8D AS loc_z",
    )


def plot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.plot_metrics(_trees(spark, sf_dir), GEO).select("tree", *_rounded("TH", "DBH", "X", "Y"))


def _sheet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sheets = exports.workbook(_sections(spark, sf_dir), _trees(spark, sf_dir), Params(stem=STEM, georeference=GEO))
    return sheets[name].select("tree", *_rounded(*[f"S{i + 1}" for i in range(STEM.sections)]))


def sheet_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, "Diameters")


def sheet_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, "X")


def sheet_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, "Q2")


def sheet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = exports.workbook(_sections(spark, sf_dir), _trees(spark, sf_dir), Params(stem=STEM, georeference=GEO))
    return sheets["Sections"].select("section", *_rounded("z0"))


def axis_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exports.axis_layer(_trees(spark, sf_dir), Draw(axis_interval=0.25))
    return out.select("tree_no", "i", *_rounded("x", "y", "z"))


def locator_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.locator_layer(_trees(spark, sf_dir)).select("tree_no", "label", "dbh_source", *_rounded("x", "y", "z", "dbh"))


def height_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.height_layer(_trees(spark, sf_dir)).select("tree_no", "axis_valid", "height_found", *_rounded("x", "y", "z", "z0"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumns({"stem_id": F.col("point_id") % 5 - 1, "tree_id": F.col("point_id") % 7 - 1, "axis_distance": (F.col("point_id") % 30) * F.lit(0.05)})


def cloud_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.cloud_layer(_placed(spark, sf_dir)).select("point_id", F.col("tree_ID").alias("tree_id"), *_rounded("x", "y", "z", "z0", "dist_axes"))


def stripe_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.stripe_layer(_placed(spark, sf_dir)).select("point_id", F.col("tree_ID").alias("tree_id"), *_rounded("x", "y", "z"))


def layer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exports.ranges(exports.cloud_layer(_placed(spark, sf_dir)), "z0", "dist_axes")
    return out.select(*_rounded("min_z0", "max_z0", "min_dist_axes", "max_dist_axes"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr("o_orderkey AS node_id", "CAST(o_orderkey div 100 AS int) AS row", "CAST(o_orderkey % 100 AS int) AS col", "(o_orderkey % 100) * 0.5D AS x", "(o_orderkey div 100) * 0.5D AS y", "o_custkey * 0.01D AS z", "o_custkey % 9 <> 0 AS is_valid")


def valid_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.terrain_layers(_nodes(spark, sf_dir))["valid_mesh"]


def valid_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.terrain_layers(_nodes(spark, sf_dir))["valid_terrain"].select("vertex", *_rounded("x", "y", "z"))


def nearest_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the points and the first three hundred trees' axes, half a metre a sample, up to two metres away."""
    cells = grid.voxels(grid.cells(points(spark, sf_dir), 0.5, 0.5))
    axes = trees.sampled(_trees(spark, sf_dir), 0.0, 4.0, 0.5)
    out = trees.nearest_axis(cells, axes, 0.5, 2.0)
    return out.select("voxel_key", *_rounded("axis_distance"), (F.col("tree_id") >= 0).alias("near"))


QUERIES = {f.__name__: f for f in (plot_metrics, sheet_diameters, sheet_x, sheet_sectors, sheet_sections, axis_layer, locator_layer, height_layer, cloud_layer, stripe_layer, layer_ranges, valid_mesh, valid_terrain, nearest_axis)}

_TREES = f"tr AS (SELECT o_orderkey AS stem_id, CAST(o_orderkey + 1 AS INT) AS tree_no, o_custkey * {_D(0.01)} AS cx, (o_custkey % 100) * {_D(0.1)} AS cy, o_orderkey % 4 <> 0 AS axis_valid, CASE WHEN o_orderkey % 7 = 0 THEN {_D(0)} ELSE {_D(0.1)} + (o_custkey % 20) * {_D(0.01)} END AS dbh, CAST(o_orderkey % 5 - 1 AS INT) AS dbh_source FROM orders WHERE o_orderkey < 300)"
_PLACED = f"{_POINTS}, pl AS (SELECT *, z AS z0, point_id % 5 - 1 AS stem_id, point_id % 7 - 1 AS tree_id, (point_id % 30) * {_D(0.05)} AS dist_axes FROM pts)"
_VALID = "v AS (SELECT o_orderkey AS node_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS vertex, o_custkey AS k FROM orders WHERE o_custkey % 9 <> 0)"


def _l(*names: str) -> str:
    return ", ".join(f"{_L(c)} AS {c}" for c in names)


def _sheet_sql(value: str) -> str:
    columns = ", ".join(f"max(CASE WHEN section_id = {i} THEN {_L(value)} END) AS s{i + 1}" for i in range(STEM.sections))
    return f"WITH {_SECTIONS}, {_TREES} SELECT 'T' || tree_no AS tree, {columns} FROM sec s JOIN tr USING (stem_id) GROUP BY tree_no"


ORACLES = {
    "plot_metrics": f"WITH {_TREES} SELECT 'T' || tree_no AS tree, {_L('(5.5 / CAST(2 AS DOUBLE))')} AS th, {_L('(dbh / 2)')} AS dbh, {_L('(cx / 2 - 10)')} AS x, {_L('(cy / 2 + 20)')} AS y FROM tr",
    "sheet_diameters": _sheet_sql("(CASE WHEN status = 0 THEN 2 * radius / 2 ELSE 0 END)"),
    "sheet_x": _sheet_sql("(CASE WHEN status = 0 THEN s.cx / 2 - 10 ELSE 0 END)"),
    "sheet_sectors": _sheet_sql("sector_percentage"),
    "sheet_sections": f"SELECT 'S' || (range + 1) AS section, {_L(f'(({_D(0.3)} + range * {_D(0.2)}) / 2)')} AS z0 FROM range({STEM.sections})",
    "axis_layer": f"WITH {_TREES}, a AS (SELECT *, (0.5 - 2) / {_D(0.8)} AS foot, 3 * {_D(0.6)} + 4 * {_D(0.8)} AS top FROM tr WHERE axis_valid) SELECT tree_no, i.range AS i, {_L('(cx + 0.6 * (foot + i.range * 0.25))')} AS x, {_L('cy')} AS y, {_L('(2 + 0.8 * (foot + i.range * 0.25))')} AS z FROM a, range(100) i WHERE i.range <= floor((top - foot) / 0.25)",
    "locator_layer": f"WITH {_TREES} SELECT tree_no, CASE WHEN dbh = 0 THEN 'Not Reliable' ELSE 'T' || tree_no END AS label, dbh_source, {_L('cx')} AS x, {_L('cy')} AS y, CAST(18000 AS BIGINT) AS z, {_l('dbh')} FROM tr",
    "height_layer": f"WITH {_TREES} SELECT tree_no, axis_valid, true AS height_found, {_L('(cx + 3)')} AS x, {_L('cy')} AS y, CAST(60000 AS BIGINT) AS z, CAST(55000 AS BIGINT) AS z0 FROM tr",
    "cloud_layer": f"WITH {_PLACED} SELECT point_id, tree_id, {_l('x', 'y', 'z', 'z0', 'dist_axes')} FROM pl",
    "stripe_layer": f"WITH {_PLACED} SELECT point_id, stem_id AS tree_id, {_l('x', 'y', 'z')} FROM pl WHERE stem_id >= 0",
    "layer_ranges": f"WITH {_PLACED} SELECT {_L('min(z0)')} AS min_z0, {_L('max(z0)')} AS max_z0, {_L('min(dist_axes)')} AS min_dist_axes, {_L('max(dist_axes)')} AS max_dist_axes FROM pl",
    "valid_terrain": f"WITH {_VALID} SELECT vertex, {_L('((node_id % 100) * 0.5)')} AS x, {_L('(node_id // 100 * 0.5)')} AS y, {_L(f'(k * {_D(0.01)})')} AS z FROM v",
    "valid_mesh": f"WITH {_VALID}, h AS (SELECT max(o_orderkey) // 100 + 1 AS h FROM orders), c AS (SELECT range AS id, (range // 99) * 100 + range % 99 AS n FROM range((SELECT 99 * (h - 1) FROM h))), t AS (SELECT id * 2 + k AS tri_id, CASE WHEN k = 0 THEN n ELSE n + 100 END AS a, n + 1 AS b, CASE WHEN k = 0 THEN n + 100 ELSE n + 101 END AS c FROM c, (VALUES (0), (1)) s(k)) SELECT tri_id, va.vertex AS a, vb.vertex AS b, vc.vertex AS c FROM t JOIN v va ON va.node_id = a JOIN v vb ON vb.node_id = b JOIN v vc ON vc.node_id = c",
    "nearest_axis": f"{_CELLS}, {_TREES}, o AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM pts), ce AS (SELECT voxel_key, ix * 0.5 + mx + 0.25 AS x, iy * 0.5 + my + 0.25 AS y, iz * 0.5 + mz + 0.25 AS z FROM vox, o), sa AS (SELECT cx - 2 / {_D(0.8)} * {_D(0.6)} + {_D(0.6)} * k.range * 0.5 AS x, cy AS y, {_D(0.8)} * k.range * 0.5 AS z FROM tr, range(10) k), d AS (SELECT voxel_key, min((ce.x - sa.x) ** 2 + (ce.y - sa.y) ** 2 + (ce.z - sa.z) ** 2) AS d2 FROM ce, sa GROUP BY 1) SELECT voxel_key, {_L('(CASE WHEN d2 <= 4 THEN sqrt(d2) ELSE 2 END)')} AS axis_distance, d2 <= 4 AS near FROM d",
}
