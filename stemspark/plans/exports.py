"""What a run gives out: the workbook's sheets and the layers of a drawing, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemspark.operators import ground
from stemspark.params import FEW_SECTORS, INNER_POINTS, SUCCESS, TILT_OUTLIER, Draw, Georeference, Params
from stemspark.storage import numbered

#: States of sections whose circles are drawn.
DRAWN = (SUCCESS, TILT_OUTLIER, INNER_POINTS, FEW_SECTORS)


def to_global(c: Column, axis: str, geo: Georeference) -> Column:
    return c / F.lit(geo.scale) - F.lit(getattr(geo, f"shift_{axis}"))


def plot_metrics(trees: DataFrame, geo: Georeference) -> DataFrame:
    return trees.select(F.concat(F.lit("T"), "tree_no").alias("tree"), (F.col("highest_z0") / geo.scale).alias("TH"), (F.col("dbh") / geo.scale).alias("DBH"), *[to_global(F.col(f"loc_{c}"), c, geo).alias(c.upper()) for c in "xy"])


def section_values(sections: DataFrame, trees: DataFrame, geo: Georeference) -> DataFrame:
    """A row a tree and section in long form; the diameter, centre and overall quality are 0 unless the section is good."""
    good = F.col("status") == SUCCESS
    rows = sections.join(trees.select("stem_id", "tree_no"), "stem_id")
    values = {"Diameters": F.when(good, 2 * F.col("radius") / geo.scale).otherwise(0.0), **{c.upper(): F.when(good, to_global(F.col(f"c{c}"), c, geo)).otherwise(0.0) for c in "xy"}, "Q": F.when(good, 1.0).otherwise(0.0), "Q1": F.col("outlier_probability"), "Q2": F.col("sector_percentage"), "Q3": F.col("number_points_inner").cast("double")}
    return rows.select("tree_no", "section_id", *[v.alias(n) for n, v in values.items()])


def workbook(sections: DataFrame, trees: DataFrame, params: Params) -> dict[str, DataFrame]:
    """The nine sheets: plot metrics, seven matrices of trees by sections (S1...), and the sections' heights."""
    geo, names = params.georeference, ("Diameters", "X", "Y", "Q", "Q1", "Q2", "Q3")
    rows = section_values(sections, trees, geo)
    ids = list(range(params.stem.sections))  # bounded by the parameters
    out = {"Plot metrics": plot_metrics(trees, geo)}
    for name in names:
        wide = rows.groupBy("tree_no").pivot("section_id", ids).agg(F.first(name))
        out[name] = wide.select(F.concat(F.lit("T"), "tree_no").alias("tree"), *[F.col(str(i)).alias(f"S{i + 1}") for i in ids])
    heights = trees.sparkSession.range(len(ids)).select((F.lit(params.stem.minimum_height) + F.col("id") * params.stem.interval).alias("z0"), "id")
    out["Sections"] = heights.select(F.concat(F.lit("S"), F.col("id") + 1).alias("section"), (F.col("z0") / geo.scale).alias("z0"))
    return out


def write_workbook(sheets: dict[str, DataFrame], folder: str, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    """A folder a sheet; mode says what happens where there is one already (errorifexists, overwrite or ignore)."""
    for name, sheet in sheets.items():
        sheet.write.mode(mode).format(file_format).option("header", "true").save(f"{folder}/{name.replace(' ', '_')}")


def circle_points(sections: DataFrame, trees: DataFrame, draw: Draw) -> DataFrame:
    """The centre (point -1) and `circle_points` points round each drawn circle, at the section's height above the stem's foot."""
    rows = sections.where(F.col("status").isin(*DRAWN)).join(trees.select("stem_id", "tree_no", "height_difference"), "stem_id")
    rows = rows.withColumn("point", F.explode(F.sequence(F.lit(-1), F.lit(draw.circle_points - 1))))
    turn = F.col("point") * (2 * 3.141592653589793 / draw.circle_points)
    r = F.when(F.col("point") < 0, 0.0).otherwise(F.col("radius"))
    return rows.select("tree_no", "stem_id", "section_id", "point", (F.col("cx") + r * F.cos(turn)).alias("x"), (F.col("cy") + r * F.sin(turn)).alias("y"), (F.col("z0") + F.col("height_difference")).alias("z"), (F.col("radius") * 2).alias("diameter"), "status", "sector_percentage", "outlier_probability", "number_points_inner", "z0")


def axis_layer(trees: DataFrame, draw: Draw) -> DataFrame:
    """Samples of each valid axis, from the stem's foot to where the highest point projects on it."""
    foot = (F.col("height_difference") - F.col("cz")) / F.col("uz")
    top = sum((F.col(f"highest_{c}") - F.col(f"c{c}")) * F.col(f"u{c}") for c in "xyz")
    rows = trees.where("axis_valid").withColumn("_foot", foot).withColumn("_length", top - foot).where("_length > 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_length") / draw.axis_interval))))
    return rows.select("tree_no", "stem_id", "i", *[(F.col(f"c{c}") + F.col(f"u{c}") * (F.col("_foot") + F.col("i") * draw.axis_interval)).alias(c) for c in "xyz"], "deviation_deg")


def locator_layer(trees: DataFrame) -> DataFrame:
    label = F.when(F.col("dbh") < 1.1920929e-07, "Not Reliable").otherwise(F.concat(F.lit("T"), "tree_no"))  # fixed value: the least single-precision step
    return trees.select("tree_no", "stem_id", *[F.col(f"loc_{c}").alias(c) for c in "xyz"], "dbh", "dbh_source", label.alias("label"))


def height_layer(trees: DataFrame) -> DataFrame:
    return trees.select("tree_no", "stem_id", *[F.col(f"highest_{c}").alias(c) for c in "xyz"], F.col("highest_z0").alias("z0"), "axis_valid", "height_found")


def cloud_layer(points: DataFrame) -> DataFrame:
    """All points with their height, their tree's id (-1: none) and their distance from its axis."""
    return points.select("point_id", "x", "y", "z", "z0", F.col("tree_id").alias("tree_ID"), F.col("axis_distance").alias("dist_axes"))


def stripe_layer(points: DataFrame) -> DataFrame:
    """The points of stems in the stripe."""
    return points.where(F.col("stem_id") >= 0).select("point_id", "x", "y", "z", F.col("stem_id").alias("tree_ID"))


def terrain_layers(nodes: DataFrame) -> dict[str, DataFrame]:
    """The terrain's nodes with the attribute invalid_ground, its triangles, and the nodes and triangles where it is valid."""
    size = nodes.agg(F.max("col").alias("c"), F.max("row").alias("r")).first()
    triangles = ground.mesh(nodes.sparkSession, (size["c"] or 0) + 1, (size["r"] or 0) + 1)
    every = nodes.select("node_id", "x", "y", "z", (~F.col("is_valid")).alias("invalid_ground"))
    valid = numbered(nodes.where("is_valid").select("node_id", "x", "y", "z"), "node_id", "vertex")
    return {"terrain": every, "terrain_mesh": triangles, "valid_terrain": valid.select((F.col("vertex") - 1).cast("long").alias("vertex"), "x", "y", "z"), "valid_mesh": ground.valid_mesh(triangles, nodes)}


def ranges(layer: DataFrame, *columns: str) -> DataFrame:
    """The least and greatest of each attribute, in one row."""
    return layer.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
