"""Voxel grids: equal cells whose origin is the smallest corner of the points they are made from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a packed key: x and y have 21 each, z the rest.
XY_BITS = 21


def packed(ix: Column, iy: Column, iz: Column) -> Column:
    return F.shiftleft(iz.cast("long"), 2 * XY_BITS).bitwiseOR(F.shiftleft(iy.cast("long"), XY_BITS)).bitwiseOR(ix.cast("long"))


def unpacked(key: Column) -> list[Column]:
    low = (1 << XY_BITS) - 1
    return [key.bitwiseAND(F.lit(low)).alias("ix"), F.shiftright(key, XY_BITS).bitwiseAND(F.lit(low)).alias("iy"), F.shiftright(key, 2 * XY_BITS).alias("iz")]


def packed_places(at: np.ndarray) -> np.ndarray:
    """packed() of an array with a row (ix, iy, iz) a cell."""
    if len(at) and at[:, :2].max() >= 1 << XY_BITS:
        raise ValueError("too many cells for a packed key")
    return (at[:, 2] << (2 * XY_BITS)) | (at[:, 1] << XY_BITS) | at[:, 0]


def places(keys: np.ndarray) -> np.ndarray:
    """ix, iy, iz of packed keys, a row each."""
    low = (1 << XY_BITS) - 1
    return np.stack([keys & low, (keys >> XY_BITS) & low, keys >> (2 * XY_BITS)], 1)


@dataclass(frozen=True)
class Lattice:
    """Equal cells from an origin on, as cells() makes them, for tasks that work on arrays."""

    x: float
    y: float
    z: float
    res_xy: float
    res_z: float

    def parts(self) -> list[tuple[str, float, float]]:
        """Coordinate, origin and edge of a cell."""
        return [("x", self.x, self.res_xy), ("y", self.y, self.res_xy), ("z", self.z, self.res_z)]

    def keys(self, batch: pa.RecordBatch) -> np.ndarray:
        """The packed key of each row's cell."""
        return packed_places(np.stack([np.floor((batch.column(c).to_numpy() - o) / r).astype(np.int64) for c, o, r in self.parts()], 1))

    def centres(self, at: np.ndarray) -> np.ndarray:
        return np.stack([at[:, i] * r + (o + r / 2) for i, (_, o, r) in enumerate(self.parts())], 1)

    def column(self, c: str) -> Column:
        """The index along an axis."""
        o, r = next(p[1:] for p in self.parts() if p[0] == c)
        return F.floor((F.col(c) - o) / r).cast("long")

    def centre(self, c: str) -> Column:
        o, r = next(p[1:] for p in self.parts() if p[0] == c)
        return self.column(c) * F.lit(r) + F.lit(o + r / 2)


def finite(points: DataFrame) -> DataFrame:
    """Without rows whose coordinates are null, NaN or infinite (NaN compares as larger than every number)."""
    return points.where(" and ".join(f"abs({c}) < double('Infinity')" for c in ("x", "y", "z")))


def cells(points: DataFrame, res_xy: float, res_z: float) -> DataFrame:
    """points with ix, iy, iz, voxel_key and the cell's centre cx, cy, cz. Empty in, empty out; a grid whose indices don't fit
    the packed key raises an error where it is used."""
    origin = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.min("z").alias("z0_"))  # one row
    out = points.crossJoin(F.broadcast(origin))
    for i, c, o, r in (("ix", "x", "x0", res_xy), ("iy", "y", "y0", res_xy), ("iz", "z", "z0_", res_z)):
        out = out.withColumn(i, F.floor((F.col(c) - F.col(o)) / F.lit(r)).cast("long"))
    most = F.greatest("ix", "iy")
    key = F.when(most < 1 << XY_BITS, packed(F.col("ix"), F.col("iy"), F.col("iz"))).otherwise(F.raise_error(F.lit("too many cells for a packed key")).cast("long"))
    out = out.withColumn("voxel_key", key)
    for c, i, o, r in (("cx", "ix", "x0", res_xy), ("cy", "iy", "y0", res_xy), ("cz", "iz", "z0_", res_z)):
        out = out.withColumn(c, F.col(i) * F.lit(r) + (F.col(o) + F.lit(r / 2)))
    return out.drop("x0", "y0", "z0_")


def voxels(of: DataFrame) -> DataFrame:
    """The occupied cells of cells()' rows: voxel_key, ix, iy, iz, x, y, z (centre), n (points)."""
    first = [F.first(c).alias(a) for c, a in (("ix", "ix"), ("iy", "iy"), ("iz", "iz"), ("cx", "x"), ("cy", "y"), ("cz", "z"))]
    return of.groupBy("voxel_key").agg(*first, F.count(F.lit(1)).alias("n"))


def area(points: DataFrame) -> DataFrame:
    """num_points and area_m2: occupied columns of one square metre (cells 2,000 m high)."""
    return cells(points, 1.0, 2000.0).agg(F.count(F.lit(1)).alias("num_points"), F.count_distinct("voxel_key").alias("area_m2"))


def discrepancy(points: DataFrame, area_m2: int, resolution: float = 1.0, height: float = 0.2525) -> DataFrame:
    """Whether the ground slice (-0.1 <= z0 <= 0.15) covers a tenth or more less or more than the plot's area, and by how much."""
    ground = points.where("z0 >= -0.1D and z0 <= 0.15D").withColumn("z", F.col("z0"))
    got = cells(ground, resolution, height).agg((F.count_distinct("voxel_key") * F.lit(resolution * resolution)).alias("a"))
    off = F.abs(F.lit(float(area_m2)) - F.col("a"))
    return got.select((off >= 0.1 * area_m2).alias("differs"), (off * 100.0 / float(area_m2)).alias("percent"))
