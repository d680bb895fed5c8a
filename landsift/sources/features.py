"""Feature layers from GeoJSON and ArcGIS JSON: features, properties, geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift.functions import geometry as G

GEOJSON = """features array<struct<id: string, properties: map<string, string>,
  geometry: struct<type: string, coordinates: string>>>"""
ARCGIS = """features array<struct<attributes: map<string, string>, properties: map<string, string>,
  geometry: struct<type: string, coordinates: string, x: double, y: double, points: array<array<double>>,
    paths: array<array<array<double>>>, rings: array<array<array<double>>>>>>"""
KINDS = {"point": ["Point", "MultiPoint"], "line": ["LineString", "MultiLineString"], "polygon": ["Polygon", "MultiPolygon"]}


def select_props(df: DataFrame, names: Sequence[str], column: str = "props") -> DataFrame:
    """The named entries of a property map as columns; a missing one is null."""
    return df.withColumns({n: F.try_element_at(F.col(column), F.lit(n)) for n in names})


def _geojson_parts(kind: Column, coordinates: Column) -> Column:
    """Coordinates of any GeoJSON geometry as parts; text of another shape gives null."""
    one = F.from_json(coordinates, "array<double>")
    two = F.from_json(coordinates, "array<array<double>>")
    three = F.from_json(coordinates, "array<array<array<double>>>")
    four = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return (
        F.when(kind == "Point", F.array(F.array(one)))
        .when(kind == "MultiPoint", F.transform(two, lambda p: F.array(p)))
        .when(kind == "LineString", F.array(two))
        .when(kind.isin("Polygon", "MultiLineString"), three)
        .when(kind == "MultiPolygon", F.flatten(four))
    )


def normalise_geometry(g: Column, arcgis: bool) -> Column:
    """GeoJSON or ArcGIS geometry to kind and parts; polygons as signed even-odd rings.

    Null where it cannot be read; rings that cross give what an odd number of them holds
    (their symmetric difference), and ``clean`` is false."""
    kind = F.lit(None).cast("string")
    for name, types in KINDS.items():
        kind = F.when(g["type"].isin(types), name).otherwise(kind)
    parts = _geojson_parts(g["type"], g["coordinates"])
    if arcgis:
        filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
        has_xy = g["x"].isNotNull() & g["y"].isNotNull()
        kind = (
            F.when(g["type"].isNotNull(), kind)
            .when(has_xy | filled(g["points"]), "point")
            .when(filled(g["paths"]), "line")
            .when(filled(g["rings"]), "polygon")
        )
        parts = (
            F.when(g["type"].isNotNull(), parts)
            .when(has_xy, F.array(F.array(F.array(g["x"], g["y"]))))
            .when(filled(g["points"]), F.transform(g["points"], lambda p: F.array(p)))
            .when(filled(g["paths"]), g["paths"])
            .when(filled(g["rings"]), g["rings"])
        )
    axis = lambda n: F.transform(parts, lambda part: F.transform(part, lambda p: F.get(p, n)))
    raw = F.struct(kind.alias("kind"), axis(0).alias("xs"), axis(1).alias("ys"))
    broken = F.exists(parts, lambda part: F.exists(part, lambda p: F.get(p, 1).isNull()))
    readable = kind.isNotNull() & parts.isNotNull() & ~F.coalesce(broken, F.lit(True))
    return F.when(readable, G.orient_rings(F.when(readable, raw)))


def _features(payload: DataFrame, arcgis: bool, layer: str, props: Sequence[str] | None, required: Sequence[str]) -> DataFrame:
    rows = payload.select(*[c for c in payload.columns if c != "features"], F.explode("features").alias("f"))
    bag = F.coalesce("f.attributes", "f.properties") if arcgis else F.col("f.properties")
    if props is not None:
        wanted = F.array(*[F.lit(p) for p in props])
        bag = F.map_filter(bag, lambda k, _: F.array_contains(wanted, k))
    needs = {"props": bag.isNotNull(), "geom": F.col("f.geometry").isNotNull()}
    for name in required:
        rows = rows.filter(needs[name])
    kept = [c for c in payload.columns if c != "features"]
    out = rows.select(
        *kept, F.lit(layer).alias("layer"), bag.alias("props"), normalise_geometry(F.col("f.geometry"), arcgis).alias("geom")
    )
    return out.withColumns(G.bbox(F.col("geom")))


def parse_layer(texts: DataFrame, layer: str, arcgis: bool = False, props=None, required=(), column: str = "value") -> DataFrame:
    """Features of JSON pages held in a text column; further columns are kept."""
    schema = ARCGIS if arcgis else GEOJSON
    payload = texts.withColumn("_p", F.from_json(column, schema)).withColumn("features", F.col("_p.features")).drop("_p", column)
    return _features(payload, arcgis, layer, props, required)


def read_geojson_layer(spark: SparkSession, path: str, layer: str, props: Sequence[str] | None = None) -> DataFrame:
    """A GeoJSON layer with the listed properties only."""
    payload = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    return _features(payload, False, layer, props, ())


def read_arcgis_layer(spark: SparkSession, path: str, layer: str, required: Sequence[str] = ()) -> DataFrame:
    """An ArcGIS layer: a folder of result pages. ``required=("props", "geom")`` skips
    features that lack either."""
    payload = spark.read.schema(ARCGIS).option("multiLine", True).json(path)
    return _features(payload, True, layer, None, required)
