"""The registered queries of the inventory's operators, on point tables derived from the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemspark.operators import cluster, grid, peel, trees
from stemspark.operators.stream import Stream
from stemspark.params import Params, Peel
from stemspark.storage import stored

#: Trees of the synthetic plot that a task works out.
TREES_A_TASK = 50
_Q = "floor({0} * 10000 + 0.5)"
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point an order; heights above ground stand in z0. Coordinates keep off cell edges."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr("o_orderkey AS point_id", "o_custkey * 0.01D + 0.00005D AS x", "floor(o_totalprice) * 0.0001D + 0.00005D AS y", "(o_orderkey % 50) * 0.1D + 0.00005D AS z", "(o_orderkey % 50) * 0.1D + 0.00005D AS z0")


_POINTS = "pts AS (SELECT o_orderkey AS point_id, o_custkey * CAST(0.01 AS DOUBLE) + CAST(0.00005 AS DOUBLE) AS x, floor(o_totalprice) * CAST(0.0001 AS DOUBLE) + CAST(0.00005 AS DOUBLE) AS y, (o_orderkey % 50) * CAST(0.1 AS DOUBLE) + CAST(0.00005 AS DOUBLE) AS z FROM orders)"


def _cells_sql(res: float, source: str = "pts") -> str:
    index = ", ".join(f"CAST(floor(({c} - min({c}) OVER ()) / CAST({res} AS DOUBLE)) AS BIGINT) AS i{c}" for c in "xyz")
    return f"cells AS (SELECT *, {index} FROM {source}), keyed AS (SELECT *, (iz << 42) | (iy << 21) | ix AS voxel_key FROM cells)"


def plot_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.area(grid.finite(points(spark, sf_dir)))


def filter_stripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(peel.band(Peel())).select("point_id")


def voxelize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.voxels(grid.cells(points(spark, sf_dir), 0.5, 0.5)).select("voxel_key", "ix", "iy", "iz", "n")


def voxel_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = grid.cells(points(spark, sf_dir), 0.5, 0.5)
    return placed.join(grid.voxels(placed).select("voxel_key", "n"), "voxel_key").select("point_id", "voxel_key", "n")


def voxel_unhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cells(points(spark, sf_dir), 0.5, 0.5).select("point_id", *grid.unpacked(F.col("voxel_key")))


def lattice_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.neighbours(grid.voxels(grid.cells(points(spark, sf_dir), 0.5, 0.5)), 0.5, 0.5).select("a", "b")


def _labels(spark: SparkSession, sf_dir: str, min_samples: int) -> DataFrame:
    return cluster.dbscan(stored(grid.voxels(grid.cells(points(spark, sf_dir), 0.5, 0.5)), "query-voxels"), 0.5, 0.5, min_samples)


def dbscan_min2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir, 2)


def dbscan_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir, 4)


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.sizes(_labels(spark, sf_dir, 2))


def large_cluster_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.large(_labels(spark, sf_dir, 2), 3)


def denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peel.denoised(points(spark, sf_dir), 0.15, 2).select("point_id")


def verticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousandths; null where the surroundings don't have one normal."""
    out = peel.verticality(grid.voxels(grid.cells(points(spark, sf_dir), 0.5, 0.5)), 1.2, 0.5, 0.5)
    known = F.when((F.col("n") < 3) | (F.col("apart") > 1e-6), F.floor(F.col("verticality") * 10000 + 0.5).cast("long"))
    return out.withColumn("verticality", known).drop("apart")


def stem_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("stem_id", F.pmod("point_id", F.lit(40)))
    out = trees.stem_stats(rows)
    return out.select("stem_id", "n", *[F.expr(_Q.format(c)).cast("long").alias(c) for c in ("cx", "cy", "cz", "z_range", "height_difference", *(f"v{p}" for p in _PAIRS))])


def forest(spark: SparkSession, sf_dir: str, copies: int = 64, orders_a_tree: int = 375, even: bool = False, sweep: float = 0.0) -> DataFrame:
    """A synthetic plot: tapered, leaning stems on a lattice, a fifth of the points on the ground of a tilted plane. Where a point
    stands on its stem's round its number says; at some numbers of trees (2,400) that leaves sectors of sections empty and gaps
    right round stems. even: the points of each twentieth of a metre of a stem are dealt round it one after the other, so that
    neither happens. sweep: a stem at height h stands sweep * h * h off its straight line, against its lean. The vote on tilted
    sections knows no scale, so on straight stems it finds outliers among deviations of hundredths of a millimetre; tilts that
    grow evenly with height, as a swept stem's do, have none. The even plot isn't stored: tasks work it out a tree at a time
    whenever it is read, which takes no more than to read it and no disk. The other one is."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    n, side = _size(o, orders_a_tree)
    if even:
        return even_forest(o, n, side, copies, sweep).frame()
    o = o.selectExpr("o_orderkey", f"o_orderkey % {n} AS t").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    rows = o.withColumn("k", F.explode_outer(F.sequence(F.lit(0), F.lit(copies - 1)))).selectExpr(f"o_orderkey * {copies} + k AS point_id", "t")
    frac = "({0} - floor({0}))"
    a, h = frac.format("point_id * 0.6180339887498949D"), frac.format("point_id * 0.7548776662466927D")
    rows = rows.selectExpr("point_id", "t", "point_id % 5 = 0 AS ground", f"4D * (t % {side}) + 2 AS bx", f"4D * floor(t / {side}) + 2 AS by", f"6D * {h} AS h", f"{a} AS fa", f"{h} AS fh")
    rows = rows.selectExpr("point_id", "t", "ground", "h", "fa", "fh", f"bx + 0.02D * (t % 3 - 1) * h + {sweep}D * h * h * CASE WHEN t % 3 = 2 THEN -1 ELSE 1 END AS ax", "by", "(0.10D + 0.01D * (t % 10)) * (1 - 0.03D * h) AS r", "2 * pi() * fa AS a")
    rows = rows.selectExpr("point_id", "t", f"CASE WHEN ground THEN fa * {4 * side} ELSE ax + r * cos(a) END AS x", f"CASE WHEN ground THEN fh * {4 * side} ELSE by + r * sin(a) END AS y", "CASE WHEN ground THEN 0D ELSE h END AS z0")
    return stored(rows.withColumn("z", F.col("z0") + 0.05 * F.col("x")), "query-forest")


def even_forest(orders: DataFrame, n: int, side: int, copies: int = 64, sweep: float = 0.0) -> Stream:
    """forest() dealt evenly, of n trees, `side` of them in a row."""
    tasks = max(4 * orders.sparkSession.sparkContext.defaultParallelism, n // TREES_A_TASK)
    keys = orders.selectExpr("o_orderkey", f"o_orderkey % {n} AS t").where("t is not null").repartition(tasks, "t").groupBy("t").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("point_id", "t") else T.DoubleType()) for c in ("point_id", "t", "x", "y", "z0", "z")])
    return Stream(keys, schema, (lambda batches: _even_trees(batches, copies, side, sweep),))


def _size(orders: DataFrame, orders_a_tree: int = 375) -> tuple[int, int]:
    """The number of trees, and of those in a row."""
    n = max(1, orders.count() // orders_a_tree)
    return n, int(-(-(n**0.5) // 1))


def _even_trees(batches: Iterator[pa.RecordBatch], copies: int, side: int, sweep: float) -> Iterator[pa.RecordBatch]:
    """The even plot's points, a batch a tree, from rows of t and its orders' keys in order."""

    def frac(v: np.ndarray) -> np.ndarray:
        return v - np.floor(v)

    for batch in batches:
        for t, keys in zip(batch.column("t").to_pylist(), batch.column("keys"), strict=True):
            p = (keys.values.to_numpy()[:, None] * copies + np.arange(copies)).ravel()
            ground, fa, fh = p % 5 == 0, frac(p * 0.6180339887498949), frac(p * 0.7548776662466927)
            h = 6.0 * fh
            part = np.floor(h * 20).astype(np.int64)
            group = part * 2 + ground
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            nth = np.empty(len(p), np.int64)
            nth[order] = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p)))) + 1
            a = 2 * np.pi * frac(nth * 0.6180339887498949 + part * 0.7548776662466927)
            r = (0.10 + 0.01 * (t % 10)) * (1 - 0.03 * h)
            ax = 4.0 * (t % side) + 2 + 0.02 * (t % 3 - 1) * h + sweep * h * h * (-1 if t % 3 == 2 else 1)
            x = np.where(ground, fa * (4 * side), ax + r * np.cos(a))
            y = np.where(ground, fh * (4 * side), 4.0 * (t // side) + 2 + r * np.sin(a))
            z0 = np.where(ground, 0.0, h)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (p, np.full(len(p), t, np.int64), x, y, z0, z0 + 0.05 * x)], ["point_id", "t", "x", "y", "z0", "z"])


def inventory_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: stripe peel and individualisation of the synthetic plot; a row a tree, at the precision at which the plot's
    formulas give it (metres, degrees; whole: most of the 9,000 points that a stem has in the stripe)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    p, cloud = Params(), even_forest(orders, *_size(orders))
    _, found = trees.individualised(cloud, peel.peel(cloud, p.stripe).frame(), p)
    return found.select(*[F.floor(F.col(c) + 0.5).cast("long").alias(a) for c, a in (("cx", "x"), ("cy", "y"), ("deviation_deg", "lean"), ("highest_z0", "height"))], (F.col("n") > 8000).alias("whole"), "axis_valid", "height_found")


QUERIES = {f.__name__: f for f in (plot_area, filter_stripe, voxelize, voxel_gather, voxel_unhash, lattice_neighbors, dbscan_min2, dbscan_border, cluster_sizes, large_cluster_semi, denoise, verticality, stem_stats, inventory_trees)}

def _ways_sql(name: str, cells: str) -> str:
    """a, b, d2 (squared steps) of the cells of a lattice that touch, both ways, among cells(voxel_key, ix, iy, iz)."""
    steps = "(SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d))"
    return f"{name} AS (SELECT p.voxel_key AS a, q.voxel_key AS b, dx * dx + dy * dy + dz * dz AS d2 FROM {cells} p, {steps} s, {cells} q WHERE q.ix = p.ix + s.dx AND q.iy = p.iy + s.dy AND q.iz = p.iz + s.dz AND p.voxel_key <> q.voxel_key)"


def _spread_sql(name: str, nodes: str, ways: str) -> str:
    """id, comp: the smallest of the nodes that each is connected with, by handing on smaller ones."""
    return f"{name}(id, comp) USING KEY (id) AS (SELECT voxel_key, voxel_key FROM {nodes} UNION (SELECT u.id, min(v.comp) FROM recurring.{name} u, {ways} e, {name} v WHERE e.a = u.id AND e.b = v.id AND v.comp < u.comp GROUP BY u.id))"


def _dbscan_sql(tag: str, cells: str, min_samples: int = 2) -> str:
    """{tag}_labels(voxel_key, label) of cells(voxel_key, ix, iy, iz)."""
    return f"""{_ways_sql(f"{tag}_ways", cells)},
    {tag}_core AS (SELECT voxel_key FROM {cells} LEFT JOIN (SELECT a, count(*) AS n FROM {tag}_ways GROUP BY a) ON a = voxel_key WHERE coalesce(n, 0) + 1 >= {min_samples}),
    {tag}_inner AS (SELECT a, b FROM {tag}_ways WHERE a IN (FROM {tag}_core) AND b IN (FROM {tag}_core)),
    {_spread_sql(f"{tag}_cc", f"{tag}_core", f"{tag}_inner")},
    {tag}_border AS (SELECT a AS voxel_key, arg_min(comp, (d2, b)) AS label FROM {tag}_ways JOIN {tag}_cc ON id = b WHERE a NOT IN (FROM {tag}_core) GROUP BY a),
    {tag}_labels AS (SELECT c.voxel_key, coalesce(k.comp, e.label, -1) AS label FROM {cells} c LEFT JOIN {tag}_cc k ON k.id = c.voxel_key LEFT JOIN {tag}_border e ON e.voxel_key = c.voxel_key)"""


def _moments_sql(tag: str, cells: str, scale: float, res: float) -> str:
    """{tag}_moments: voxel_key, n and sums over the cells nearer than scale."""
    r = int(scale / res) + 1
    span = f"(SELECT range - {r} AS d FROM range({2 * r + 1}))"
    sums = ", ".join(f"CAST(coalesce(sum({'*'.join(f'd{c}' for c in p)}), 0) AS BIGINT) AS s{p}" for p in ("x", "y", "z", *_PAIRS))
    return f"""{tag}_ball AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM {span} a, {span} b, {span} c WHERE (a.d * a.d + b.d * b.d) * CAST({res**2!r} AS DOUBLE) + (c.d * CAST({res} AS DOUBLE)) * (c.d * CAST({res} AS DOUBLE)) < CAST({scale * scale!r} AS DOUBLE)),
    {tag}_moments AS (SELECT p.voxel_key, count(*) AS n, {sums} FROM {cells} p, {tag}_ball s, {cells} q WHERE q.ix = p.ix + s.dx AND q.iy = p.iy + s.dy AND q.iz = p.iz + s.dz GROUP BY p.voxel_key)"""


def _axes_sql(tag: str, source: str, key: str, cov: dict[str, str]) -> str:
    """{tag}_axes: key, least, middle, most (variances) and the squared vertical parts of the least and the most axis, from the
    covariances: eigenvalues of a symmetric matrix in closed form, parts of eigenvectors by those of the minor."""
    return f"""{tag}_c AS (SELECT {key}, {', '.join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in cov.items())} FROM {source}),
    {tag}_q AS (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM {tag}_c),
    {tag}_r AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 ELSE 0 END AS turn FROM {tag}_q),
    {tag}_e AS (SELECT *, q + 2 * p * cos(turn) AS most, q + 2 * p * cos(turn + 2 * pi() / 3) AS least FROM {tag}_r),
    {tag}_m AS (SELECT *, 3 * q - most - least AS middle FROM {tag}_e),
    {tag}_axes AS (SELECT {key}, least, middle, most, CASE WHEN middle > least THEN greatest(0, ((least - xx) * (least - yy) - xy * xy) / ((least - middle) * (least - most))) END AS least_z2, greatest(0, ((most - xx) * (most - yy) - xy * xy) / ((most - middle) * (most - least))) AS most_z2,
        (most - yy) * (most - zz) - yz * yz AS mxx, xy * (most - zz) + xz * yz AS mxy, xz * (most - yy) + xy * yz AS mxz, (most - xx) * (most - zz) - xz * xz AS myy, yz * (most - xx) + xy * xz AS myz, (most - xx) * (most - yy) - xy * xy AS mzz FROM {tag}_m)"""


def _moments_cov(res: float) -> dict[str, str]:
    return {p: f"((s{p} * CAST(1 AS DOUBLE) / n - (s{p[0]} * CAST(1 AS DOUBLE) / n) * (s{p[1]} * CAST(1 AS DOUBLE) / n)) * {res * res!r})" for p in _PAIRS}


def plot_sql(orders_a_tree: int = 375) -> str:
    """true_trees(t, x, y, lean): what forest() is made from."""
    return f"f0 AS (SELECT greatest(1, count(*) // {orders_a_tree}) AS n FROM orders), f1 AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS side FROM f0), true_trees AS (SELECT range AS t, 4 * (range % side) + 2 AS x, 4 * (range // side) + 2 AS y, CASE WHEN range % 3 = 1 THEN 0 ELSE 1 END AS lean FROM f1, range((SELECT n FROM f0)))"


_VOX = "vox AS (SELECT DISTINCT voxel_key, ix, iy, iz FROM keyed)"
_CELLS = f"WITH RECURSIVE {_POINTS}, {_cells_sql(0.5)}, {_VOX}"

ORACLES = {
    "plot_area": f"WITH {_POINTS} SELECT count(*) AS num_points, count(DISTINCT (floor(x - mx), floor(y - my))) AS area_m2 FROM pts, (SELECT min(x) AS mx, min(y) AS my FROM pts)",
    "filter_stripe": f"WITH {_POINTS} SELECT point_id FROM pts WHERE z > 0.7 AND z < 3.5",
    "voxelize": f"WITH {_POINTS}, {_cells_sql(0.5)} SELECT voxel_key, ix, iy, iz, count(*) AS n FROM keyed GROUP BY ALL",
    "voxel_gather": f"WITH {_POINTS}, {_cells_sql(0.5)} SELECT point_id, voxel_key, count(*) OVER (PARTITION BY voxel_key) AS n FROM keyed",
    "voxel_unhash": f"WITH {_POINTS}, {_cells_sql(0.5)} SELECT point_id, ix, iy, iz FROM keyed",
    "lattice_neighbors": f"{_CELLS}, {_ways_sql('ways', 'vox')}, o AS (SELECT w.a, w.b, q.ix - p.ix AS dx, q.iy - p.iy AS dy, q.iz - p.iz AS dz FROM ways w JOIN vox p ON w.a = p.voxel_key JOIN vox q ON w.b = q.voxel_key) SELECT a, b FROM o WHERE dx > 0 OR (dx = 0 AND (dy > 0 OR (dy = 0 AND dz > 0)))",
    "dbscan_min2": f"{_CELLS}, {_dbscan_sql('d', 'vox', 2)} SELECT voxel_key, label FROM d_labels",
    "dbscan_border": f"{_CELLS}, {_dbscan_sql('d', 'vox', 4)} SELECT voxel_key, label FROM d_labels",
    "cluster_sizes": f"{_CELLS}, {_dbscan_sql('d', 'vox', 2)} SELECT label, count(*) AS n FROM d_labels WHERE label >= 0 GROUP BY label",
    "large_cluster_semi": f"{_CELLS}, {_dbscan_sql('d', 'vox', 2)} SELECT voxel_key, label FROM d_labels WHERE label IN (SELECT label FROM d_labels WHERE label >= 0 GROUP BY label HAVING count(*) > 3)",
    "denoise": f"WITH RECURSIVE {_POINTS}, {_cells_sql(0.15)}, {_VOX}, {_dbscan_sql('d', 'vox', 2)}, j AS (SELECT point_id, label FROM keyed JOIN d_labels USING (voxel_key) WHERE label >= 0) SELECT point_id FROM j WHERE label IN (SELECT label FROM j GROUP BY label HAVING count(*) > 2)",
    "verticality": f"{_CELLS}, {_moments_sql('v', 'vox', 1.2, 0.5)}, {_axes_sql('v', 'v_moments', 'voxel_key', _moments_cov(0.5))} SELECT m.voxel_key, n, sx, sy, sz, {', '.join(f's{p}' for p in _PAIRS)}, CASE WHEN n < 3 THEN 0 WHEN (middle - least) / (least + middle + most) > 1e-6 THEN CAST({_Q.format('(1 - sqrt(least_z2))')} AS BIGINT) END AS verticality FROM v_moments m JOIN v_axes USING (voxel_key)",
    "inventory_trees": f"WITH {plot_sql()} SELECT x, y, lean, true AS whole, CAST(6 AS BIGINT) AS height, true AS axis_valid, true AS height_found FROM true_trees",
    "stem_stats": f"WITH {_POINTS} SELECT point_id % 40 AS stem_id, count(*) AS n, CAST({_Q.format('avg(x)')} AS BIGINT) AS cx, CAST({_Q.format('avg(y)')} AS BIGINT) AS cy, CAST({_Q.format('avg(z)')} AS BIGINT) AS cz, CAST({_Q.format('(max(z) - min(z))')} AS BIGINT) AS z_range, CAST({_Q.format('(avg(z) - avg(z))')} AS BIGINT) AS height_difference, {', '.join(f"CAST({_Q.format(f'covar_pop({a}, {b})')} AS BIGINT) AS v{a}{b}" for a, b in _PAIRS)} FROM pts GROUP BY 1",
}
