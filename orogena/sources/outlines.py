"""Region outlines and indexes: .poly texts and GeoJSON feature collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINT = T.ArrayType(T.DoubleType())
_FEATURES = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("properties", T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("urls", T.MapType(T.StringType(), T.StringType()))])),
                        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
                    ]
                )
            ),
        )
    ]
)


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, hole, pos, lon, lat): the points of each section of .poly files; a section named !… is a hole."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    lines = text.select("path", "line_no", F.trim("line").alias("line")).where("line <> ''")
    # the first line names the file; a line that isn't a point and isn't END starts a section
    order = Window.partitionBy("path").orderBy("line_no")
    point = F.col("line").rlike(r"^[-+0-9.eE]+\s+[-+0-9.eE]+")
    starts = (~point & (F.col("line") != "END") & (F.col("line_no") > 0)).cast("int")
    told = lines.withColumn("section", F.sum(starts).over(order)).withColumn("point", point)
    named = told.withColumn("name", F.max(F.when(starts == 1, F.col("line"))).over(Window.partitionBy("path", "section")))
    xy = F.split("line", r"\s+")
    place = (F.row_number().over(Window.partitionBy("path", "section").orderBy("line_no")) - 1).alias("pos")
    return named.where("point AND section > 0").select("path", "section", F.col("name").startswith("!").alias("hole"), place, F.element_at(xy, 1).cast("double").alias("lon"), F.element_at(xy, 2).cast("double").alias("lat"))


def read_region_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Regions (id, name, parent, url, children) and boxes (id, ring, min_lat, min_lon, max_lat, max_lon), one for each outer ring."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", _FEATURES).alias("x"))
    f = text.select(F.explode("x.features").alias("f")).where("f.properties.id IS NOT NULL").select("f.properties.id", "f.properties.name", "f.properties.parent", F.col("f.properties.urls")["pbf"].alias("url"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    below = f.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    regions = f.join(below, "id", "left").select("id", "name", "parent", "url", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    many = F.when(F.col("type") == "MultiPolygon", F.from_json("c", T.ArrayType(T.ArrayType(T.ArrayType(_POINT))))).when(F.col("type") == "Polygon", F.array(F.from_json("c", T.ArrayType(T.ArrayType(_POINT)))))
    rings = f.select("id", F.posexplode(F.transform(many, lambda p: F.get(p, F.lit(0)))).alias("ring", "r"))
    at = lambda i, g: g(F.transform("r", lambda p: F.get(p, F.lit(i))))
    boxes = rings.select("id", "ring", at(1, F.array_min).alias("min_lat"), at(0, F.array_min).alias("min_lon"), at(1, F.array_max).alias("max_lat"), at(0, F.array_max).alias("max_lon"))
    return regions, boxes
