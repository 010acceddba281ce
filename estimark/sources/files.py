"""Files in and out: zone prices, zone polygons, portal items, snapshots, CSV export, caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from estimark.functions.scalars import exactly
from estimark.operators.lookup import first_by_priority

VALUE_COLUMNS = "Area_territoriale Regione Prov Comune_ISTAT Comune_cat Sez Comune_amm Comune_descrizione Fascia Zona LinkZona Cod_Tip Descr_Tipologia Stato Stato_prev Compr_min Compr_max Sup_NL_compr Loc_min Loc_max Sup_NL_loc".split()


def decimal_comma(text: Column | str) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def read_zone_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a semicolon-separated Latin-1 file whose first line is a title and second the
    header. Columns are named by the header, which must be the same in all files of the path."""
    lines = in_order(spark.read.option("encoding", "ISO-8859-1").text(path))
    # the header is the first line with this many separators
    header = lines.where(F.col("value").startswith("Area_territoriale;")).orderBy("line").limit(1).first()
    names = [n for n in header["value"].split(";") if n] if header else []
    parts = F.split("value", ";")
    body = lines.where(F.col("value").contains(";") & ~F.col("value").startswith("Area_territoriale;"))
    return body.select(*[F.nullif(F.trim(F.regexp_replace(F.get(parts, F.lit(k)), "^'|'$", "")), F.lit("")).alias(n) for k, n in enumerate(names)], "line")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` of files with ``line``, which puts them in the files' order: by file, block of
    the file, and place in the block."""
    return rows.withColumn("line", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))


def files_about(spark: SparkSession, path: str, comune: str) -> DataFrame:
    """(file): the first file of the path, by name, that has a row of the municipality."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(F.array_contains(F.transform(F.split("value", ";"), lambda x: F.trim(x)), comune)).agg(F.min("file").alias("file")).where("file IS NOT NULL")


def zone_prices(values: DataFrame, kind: str = "20") -> DataFrame:
    """(comune, zona, prices) of flats: the state NORMALE before OTTIMO, the first row wins."""
    rank = F.when(F.col("Stato") == "NORMALE", 0).when(F.col("Stato") == "OTTIMO", 1)
    rows = values.where((F.col("Cod_Tip") == kind) & rank.isNotNull()).withColumn("rank", rank)
    one = first_by_priority(rows, ["Comune_amm", "Zona"], ["rank", "line"])
    n = {c: decimal_comma(c) for c in ("Compr_min", "Compr_max", "Loc_min", "Loc_max")}
    middle = lambda a, b, places: exactly((n[a] + n[b]) / 2, places)
    return one.select(F.col("Comune_amm").alias("comune"), F.col("Zona").alias("zona"), *[v.alias(k.lower()) for k, v in n.items()], middle("Compr_min", "Compr_max", 0).alias("compr_mid"), middle("Loc_min", "Loc_max", 2).alias("loc_mid"))


def read_polygons(spark: SparkSession, path: str, city: str) -> DataFrame:
    """(city, zona, ord, polygons) of a KML file's placemarks; the name ends with the zone."""
    ring = "struct<LinearRing:struct<coordinates:string>>"
    polygon = f"struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>"
    schema = f"name string, Polygon array<{polygon}>, MultiGeometry struct<Polygon:array<{polygon}>>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)

    def points(text: Column) -> Column:
        pairs = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p.contains(","))
        return F.transform(pairs, lambda p: F.array(F.get(F.split(p, ","), 0).cast("double"), F.get(F.split(p, ","), 1).cast("double")))

    def rings(p: Column) -> Column:
        outer = F.array(points(p["outerBoundaryIs"]["LinearRing"]["coordinates"]))
        inner = F.transform(F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{ring}>")), lambda r: points(r["LinearRing"]["coordinates"]))
        return F.concat(outer, inner)

    shapes = F.concat(F.coalesce("Polygon", F.array().cast(f"array<{polygon}>")), F.coalesce("MultiGeometry.Polygon", F.array().cast(f"array<{polygon}>")))
    marks = in_order(marks)
    out = marks.select(F.lit(city).alias("city"), F.element_at(F.split(F.trim("name"), r"\s+"), -1).alias("zona"), F.col("line").alias("ord"), F.filter(F.transform(shapes, rings), lambda p: F.size(p[0]) >= 3).alias("polygons"))
    return out.where(F.size("polygons") > 0)


def item_list(df: DataFrame, column: str) -> DataFrame:
    """One row an item of a JSON-LD ItemList: url, name, and the id at the end of the url."""
    schema = "struct<itemListElement:array<struct<url:string,name:string>>>"
    items = df.select("*", F.explode(F.from_json(column, schema)["itemListElement"]).alias("item"))
    return items.select(*df.columns, F.col("item.url").alias("item_url"), F.col("item.name").alias("item_name"), F.element_at(F.filter(F.split("item.url", "/"), lambda p: p != ""), -1).alias("item_id"))


def slim(df: DataFrame) -> DataFrame:
    """``df`` without columns whose names begin with _, and with null for empty texts, lists and
    maps, and for structs without a value in any field (0 and false stay)."""

    def kept(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType):
            return F.nullif(c, F.lit(""))
        if isinstance(kind, ArrayType | MapType):
            return F.when(F.size(c) > 0, c)
        if isinstance(kind, StructType):
            return F.when(reduce(lambda a, b: a | b, [c[f.name].isNotNull() for f in kind], F.lit(False)), c)
        return c

    return df.select(*[kept(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if not f.name.startswith("_")])


def write_snapshot(df: DataFrame, path: str) -> None:
    slim(df).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns, null where the frame lacks one."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", "true").csv(path)


def save_cache(df: DataFrame, path: str) -> None:
    """Enrichment rows by source; only the sources written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("source").agg(F.count("*").alias("n"), F.min("enriched_at").alias("oldest"), F.max("enriched_at").alias("newest"))


def read_snapshot(spark: SparkSession, path: str, schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a snapshot with all columns of the schema (absent ones null), without the ``drop``
    columns that older snapshots have."""
    df = spark.read.schema(schema).json(path)
    return df.select(*[c for c in df.columns if c not in drop])


def load_cache(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Cached rows, of one source or all; only that source's folder is read."""
    df = spark.read.parquet(path)
    return df.where(F.col("source") == source) if source else df


def cached(spark: SparkSession, path: str, source: str, key: str, ids: list) -> DataFrame:
    """The cached rows of some ids."""
    return load_cache(spark, path, source).where(F.col(key).isin(ids))


def clear_cache(spark: SparkSession, path: str) -> None:
    """Leaves the cache's folder and schema, without rows."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
