"""Cell geometry: GeoJSON features to a lookup of cell, geometry text and centroid."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens import schema as S

_FEATURE_FIELDS = "type:string, id:long, properties:struct<cellId:long>, geometry:string"


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection documents: grid_id (properties.cellId, not the 0-based id) and geometry text.

    Each file is read by one task; read_split_features reads large documents in parallel.
    """
    documents = (
        spark.read.schema(f"type string, features array<struct<{_FEATURE_FIELDS}>>").option("multiLine", True).json(path)
    )
    checked = documents.withColumn(
        "features",
        F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(
            F.raise_error(F.lit("unexpected GeoJSON top-level type"))
        ),
    )
    return checked.select(F.inline("features")).select(F.col("properties.cellId").alias("grid_id"), "geometry")


def _without_strings(text: Column, inside: bool) -> Column:
    """The text of a piece with what is inside its strings blanked, length kept; inside: whether it starts in a string."""
    plain = F.regexp_replace(text, r"(?s)\\.", "__")
    parts = F.transform(
        F.split(plain, '"'),
        lambda part, i: F.when(i % 2 == F.lit(0 if inside else 1), F.repeat(F.lit(" "), F.length(part))).otherwise(part),
    )
    return F.array_join(parts, '"')


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _sum_before(pieces: DataFrame, name: str) -> DataFrame:
    """Adds before_<name>: the sum of a column over all earlier pieces of the file. Splits are added up as a row each."""
    in_split = Window.partitionBy("file", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.groupBy("file", "block").agg(F.sum(name).alias("_whole"))
    starts = splits.select("file", "block", F.coalesce(F.sum("_whole").over(earlier), F.lit(0)).alias("_start"))
    joined = pieces.join(starts, ["file", "block"])
    return joined.withColumn(f"before_{name}", F.col("_start") + F.coalesce(F.sum(name).over(in_split), F.lit(0))).drop("_start")


def split_objects(pieces: DataFrame) -> DataFrame:
    """file, the text of every object inside the outermost one of a JSON document, and whether the document is a FeatureCollection.

    pieces: file, block, position and value, the document cut behind every closing brace, without it. A piece may start within a
    string, which the quotes before it tell, and at any depth, which the braces before it tell once strings are blanked; both are sums over earlier pieces.
    """
    text = F.col("value")
    quotes = _count(F.regexp_replace(text, r"(?s)\\.", ""), '"')
    known = _sum_before(pieces.withColumn("quotes", quotes), "quotes")
    starts_inside, ends_inside = F.col("before_quotes") % 2 == 1, (F.col("before_quotes") + F.col("quotes")) % 2 == 1
    blanked = F.when(starts_inside, _without_strings(text, True)).otherwise(_without_strings(text, False))
    depths = known.withColumn("blanked", blanked).withColumn("depth", _count(F.col("blanked"), "{") - F.when(ends_inside, 0).otherwise(1))
    depths = _sum_before(depths, "depth")
    depths = depths.withColumn("closes", F.when(~ends_inside & (F.col("before_depth") + F.col("depth") <= 1), 1).otherwise(0))
    numbered = _sum_before(depths, "closes")
    # what stands between objects goes, up to the brace that opens the next one; pieces of nothing else go whole
    upto = F.when(F.col("before_depth") == 0, F.substring_index("blanked", "{", 2)).otherwise(F.substring_index("blanked", "{", 1))
    opening, outside = F.length(upto), F.col("before_depth") <= 1
    own = F.when(~outside, text).when(opening < F.length(text), F.substr(text, opening + 1))
    between = F.when(outside, F.substr(text, F.lit(1), opening))
    shown = numbered.select("file", "block", "position", F.col("before_closes").alias("object"), own.alias("own"), between.alias("between"))
    parts = F.sort_array(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("block", "position", "own"))))
    objects = shown.groupBy("file", "object").agg(parts.alias("parts"), F.max(F.col("between").rlike(r'"type"\s*:\s*"FeatureCollection"')).alias("named"))
    whole = F.concat(F.array_join(F.transform("parts", lambda p: p["own"]), "}"), F.lit("}"))
    named = objects.select("file", whole.alias("text"), "named")
    documents = named.groupBy("file").agg(F.max("named").alias("is_collection"))
    return named.select("file", "text").join(documents, "file")


def read_split_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection documents of any size, as read_feature_collection gives them; a document is read by many tasks."""
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"), "value",
    )
    parsed = split_objects(pieces).withColumn("feature", F.from_json("text", f"struct<{_FEATURE_FIELDS}>")).where(F.col("feature.type") == "Feature")
    wrong = F.raise_error(F.lit("unexpected GeoJSON top-level type")).cast("long")
    cell = F.when(F.col("is_collection"), F.col("feature.properties.cellId")).otherwise(wrong)
    return parsed.select(cell.alias("grid_id"), F.col("feature.geometry").alias("geometry"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from files with one feature per line; these split over any number of tasks."""
    features = spark.read.schema("properties struct<cellId:long>, geometry string").json(path)
    return features.select(F.col("properties.cellId").alias("grid_id"), "geometry")


def read_lookup_lines(spark: SparkSession, path: str) -> DataFrame:
    """A lookup saved as JSON lines."""
    return spark.read.schema(S.LOOKUP_SCHEMA).json(path)


def exterior_ring(geometry: Column) -> Column:
    """array<array<double>> of [lon, lat] points; fails on anything but Polygon and MultiPolygon."""
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return (
        F.when(kind == "Polygon", polygon[0])
        .when(kind == "MultiPolygon", multi[0][0])
        .otherwise(F.raise_error(F.concat(F.lit("unexpected geometry type: "), F.coalesce(kind, F.lit("none")))))
    )


def _mean(ring: Column, axis: int) -> Column:
    return F.aggregate(ring, F.lit(0.0), lambda total, point: total + point[axis]) / F.size(ring)


def grid_lookup(features: DataFrame) -> DataFrame:
    """grid_id, geometry_json, centroid; the centroid is the plain mean of the ring's points as listed."""
    ring = F.col("ring")
    return (
        features.where(F.col("grid_id").isNotNull())
        .withColumn("ring", exterior_ring(F.col("geometry")))
        .select(
            F.col("grid_id").cast("long").alias("grid_id"),
            F.col("geometry").alias("geometry_json"),
            _mean(ring, 0).alias("centroid_lon"),
            _mean(ring, 1).alias("centroid_lat"),
        )
    )


def load_grid_lookup(spark: SparkSession, path: str) -> DataFrame:
    return grid_lookup(read_feature_collection(spark, path))
