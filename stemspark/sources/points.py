"""Point tables from flat buffers, tables and text files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_buffer(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """x, y, z, x, y, z, ... ; an incomplete last triple is dropped. For clouds that fit the driver."""
    flat = np.asarray(values, np.float64).ravel()
    rows = flat[: len(flat) // 3 * 3].reshape(-1, 3)
    frame = pd.DataFrame({"point_id": np.arange(len(rows)), "x": rows[:, 0], "y": rows[:, 1], "z": rows[:, 2]})
    return spark.createDataFrame(frame, "point_id long, x double, y double, z double")


def from_table(table: DataFrame, x: str = "x", y: str = "y", z: str = "z", z0: str | None = None, point_id: str | None = None) -> DataFrame:
    """A table's columns as doubles; without an id column rows are numbered (uniquely, with gaps). A missing column is an error."""
    wanted = [c for c in (x, y, z, z0, point_id) if c]
    if missing := [c for c in wanted if c not in table.columns]:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(table.columns)}")
    key = F.col(point_id).cast("long") if point_id else F.monotonically_increasing_id()
    return table.select(key.alias("point_id"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"), (z0, "z0")) if c])


def height_columns(table: DataFrame) -> tuple[list[str], str | None]:
    """The columns that could hold heights, and the one to take unless told otherwise: Z0, if there is one."""
    numeric = [f.name for f in table.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    return numeric, next((c for c in numeric if c.lower() == "z0"), None)


def from_text(spark: SparkSession, path: str, separator: str = " ", z0: bool = False) -> DataFrame:
    """Lines of x y z (z0); lines that don't parse give nulls, which grid.finite drops."""
    names = ["x", "y", "z"] + (["z0"] if z0 else [])
    rows = spark.read.schema(", ".join(f"{n} double" for n in names)).option("sep", separator).csv(path)
    return from_table(rows, z0="z0" if z0 else None)
