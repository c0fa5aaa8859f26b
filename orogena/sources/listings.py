"""Text listings: tile areas, published tile names, coverage pages and rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """(tile, min_lat, min_lon, max_lat, max_lon) of lines ``63240001: 2144256,-3411968 to 2162688,-3397632``; comments go."""
    line = spark.read.text(path).where(~F.col("value").startswith("#"))
    part = lambda i: F.regexp_extract("value", r"^\s*(\d+)\s*:\s*(-?\d+)\s*,\s*(-?\d+)\s+to\s+(-?\d+)\s*,\s*(-?\d+)", i)
    named = line.select(*[part(i + 1).try_cast("int").alias(c) for i, c in enumerate(("tile", "min_lat", "min_lon", "max_lat", "max_lon"))])
    return named.where("tile IS NOT NULL")


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon): each cell that an object's name in a published list names, as in ``…_N44_00_E033_00_DEM``, once."""
    text = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"([NS]\d{2}_\d{2}_[EW]\d{3})"), F.lit(1))).alias("n"))
    sign = lambda at, minus: F.when(F.substring("n", at, 1) == minus, -1).otherwise(1)
    return text.select((sign(1, "S") * F.substring("n", 2, 2).cast("int")).alias("lat"), (sign(8, "W") * F.substring("n", 9, 3).cast("int")).alias("lon")).distinct()


def coverage(pages: DataFrame) -> DataFrame:
    """(url, title) of the <area> elements of pages (html), whichever way their attributes are quoted."""
    areas = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<area\b[^>]*>)"), F.lit(1))).alias("a"))
    attribute = lambda k: F.concat(*[F.regexp_extract("a", rf"(?is)\b{k}\s*=\s*{q}", 1) for q in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")])
    return areas.select(attribute("href").alias("url"), attribute("title").alias("title")).where("url <> ''")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, condition, code, resolution, onward) of rules ``condition [0x0f resolution 22 continue]``.

    A rule may run over lines that end or start with an operator; reading stops at ``<finalize>``. Comments go.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    bare = F.element_at(F.split(F.regexp_replace("value", r"(?m)#.*$", ""), "<finalize>"), 1)
    rules = text.select("path", F.posexplode(F.regexp_extract_all(bare, F.lit(r"([^\[\]]*\[[^\]]*\])"), F.lit(1))).alias("ord", "rule"))
    part = lambda p, i=1: F.regexp_extract("rule", p, i)
    condition = F.trim(F.regexp_replace(part(r"(?s)^(.*?)(\{[^}]*\}\s*)*\["), r"\s+", " "))
    return rules.select(
        "path", "ord", condition.alias("condition"), F.conv(part(r"\[\s*0x([0-9a-fA-F]+)"), 16, 10).try_cast("int").alias("code"),
        part(r"(?:resolution|level)\s+(\d+)").try_cast("int").alias("resolution"), F.col("rule").rlike(r"\bcontinue\b").alias("onward"),
    )
