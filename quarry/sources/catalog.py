"""Reading and writing catalogs, snapshots, exports and user data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import blank
from quarry.operators.keyed import latest_wins

CARD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "setId", "setName", "localId", "rarity", "imageBase", "language")] + [T.StructField("dexNumber", T.IntegerType()), T.StructField("hostedThumbUrl", T.StringType()), T.StructField("hostedFullUrl", T.StringType())])


def parse_catalog(texts: DataFrame, column: str, item: T.DataType) -> DataFrame:
    """Texts of ``{key: [item, ...]}`` to rows key, pos, item columns; a text that doesn't parse gives none."""
    parsed = texts.select(F.from_json(column, T.MapType(T.StringType(), T.ArrayType(item))).alias("m"))
    lists = parsed.select(F.explode("m").alias("key", "items"))
    return lists.select("key", F.posexplode("items").alias("pos", "item")).select("key", "pos", "item.*")


def read_catalog(spark: SparkSession, path: str, item: T.DataType = CARD, pattern: str = "*.json") -> DataFrame:
    """All catalog files below ``path``, each one JSON text; a broken file reads as no data."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return parse_catalog(texts, "value", item)


def catalog_path(language: Column, generation: Column) -> Column:
    """``lang.json`` for the first generation, else ``lang/gen<n>.json``."""
    return F.when(generation == 1, F.concat(language, F.lit(".json"))).otherwise(F.concat(language, F.lit("/gen"), generation.cast("string"), F.lit(".json")))


def language_from_path(path: Column, root: str = "") -> Column:
    """First part of a path below the root, without ``.json``."""
    return F.regexp_replace(F.regexp_extract(F.replace(path, F.lit(root), F.lit("")), r"^/*([^/]+)", 1), r"\.json$", "")


def write_catalog(df: DataFrame, path: str, partitions: Sequence[str] = ("language", "generation")) -> None:
    """Partitioned Parquet, rows of a partition value together, so that readers prune by folder; a hot value is split over tasks."""
    df.hint("rebalance", *partitions).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def collect_by_pattern(spark: SparkSession, path: str, language: str, pattern: str, columns: Sequence[str]) -> DataFrame:
    """Rows of all generations of a language whose name matches: the columns, generation, file, and place in the file.

    Folders of other languages aren't read, nor other columns.
    """
    rows = spark.read.parquet(path).where(F.col("language") == language)
    return rows.where(F.col("name").rlike(pattern)).select(*columns, "generation", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))


def id_index(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each id in the order of the files and of the rows in them, generation by generation."""
    return latest_wins(rows, [key], ["generation", "file", "at"])


def read_catalog_partition(spark: SparkSession, path: str, **values) -> DataFrame:
    """One partition of a written catalog; the filter prunes folders."""
    df = spark.read.parquet(path)
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    return df


def split_corrupt(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON texts parsed permissively, with ``broken`` for those that don't parse."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return df.withColumn("record", F.from_json(column, with_bad, {"mode": "PERMISSIVE"})).withColumn("broken", F.col("record").isNull() | F.col("record._corrupt_record").isNotNull())


def read_record_tree(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "record.json") -> DataFrame:
    """Records of all matching files below ``path``; those that don't parse are marked ``broken``."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return split_corrupt(texts.withColumn("path", F.col("_metadata.file_path")), "value", schema)


def latest(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """The lexicographically last name with the prefix; none is an error."""
    last = names.where(F.col(column).startswith(prefix)).agg(F.max(column).alias("latest"))
    return last.select(F.coalesce("latest", F.raise_error(F.lit(f"nothing begins with {prefix}")).cast("string")).alias("latest"))


def explode_languages(df: DataFrame, names: str, language: str = "language", text: str = "name") -> DataFrame:
    """A map of language to text as one row for each language whose text isn't empty."""
    return df.select("*", F.explode(names).alias(language, text)).where(blank(F.col(text)).isNotNull()).drop(names)


def availability(df: DataFrame, index: DataFrame | None, keys: Sequence[str], base: str) -> DataFrame:
    """``url`` from the keys where the index holds them, else null; without an index null for all."""
    if index is None:
        return df.withColumn("url", F.lit(None).cast("string"))
    held = index.select(*keys).distinct().withColumn("_there", F.lit(True))
    return df.join(held, list(keys), "left").withColumn("url", F.when(F.col("_there"), F.concat_ws("/", F.lit(base), *keys))).drop("_there")


def gaps(df: DataFrame, column: str) -> DataFrame:
    """Ranges of integers that are missing between the smallest and the largest value: first, last.

    Neighbours are found within ranges of the values and at their edges, so that no task sees the whole column.
    """
    values = df.select(F.col(column).cast("long").alias("v")).distinct()
    step = 1 << 16
    cells = values.groupBy(F.floor(F.col("v") / step).alias("cell")).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    inner = cells.select(F.explode(F.zip_with(F.slice("vs", 1, F.size("vs") - 1), F.slice("vs", 2, F.size("vs")), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))).alias("g")).select("g.*")
    ends = cells.select("cell", F.element_at("vs", 1).alias("low"), F.element_at("vs", -1).alias("high"))
    between = ends.select((F.lag("high").over(Window.orderBy("cell")) + 1).alias("first"), (F.col("low") - 1).alias("last"))  # a row for each 65,536 values
    return inner.unionByName(between).where("first <= last")


def require_gapless(df: DataFrame, column: str, n: int) -> DataFrame:
    """``df`` if ``column`` holds each of 1..n; else the job fails."""
    held = F.countDistinct(F.when(F.col(column).between(1, n), F.col(column)))
    checked = df.agg(F.when(held == n, F.lit(True)).otherwise(F.raise_error(F.lit("numbers are missing")).cast("boolean")).alias("_ok"))
    return df.crossJoin(F.broadcast(checked)).where("_ok").drop("_ok")  # one row


def read_species(spark: SparkSession, path: str, language: str, glyphs: tuple[str, str] = ("’♀♂", "'FM")) -> DataFrame:
    """Species names (species_id, language_id, name) of one language from CSV, some glyphs rewritten."""
    rows = spark.read.schema("species_id int, language_id string, name string").option("header", True).csv(path)
    return rows.where(F.col("language_id") == language).select("species_id", F.translate("name", *glyphs).alias("name"))


def dimension_diff(trusted: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of the trusted dimension that the other one lacks or names otherwise."""
    o = other.select(key, F.col(name).alias("other_name"))
    out = trusted.select(key, name).join(o, key, "left")
    return out.where(~F.coalesce(F.col("other_name") == F.col(name), F.lit(False))).withColumn("issue", F.when(F.col("other_name").isNull(), "missing").otherwise("renamed"))


def integers_in(text: Column, low: int, high: int) -> Column:
    """Distinct integers of a free text within a range, in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), lambda d: F.try_to_number(F.substring(d, 1, 18), F.lit("9" * 18)).cast("long"))
    return F.array_distinct(F.filter(found, lambda i: i.between(low, high)))


def read_supplemental(df: DataFrame, kind: str, required: Sequence[str], wanted: str, number: str, url: str, low: int, high: int) -> DataFrame:
    """Supplemental records: type contains ``wanted`` and required fields are there; one row for each number in range.

    ``detail_id`` is the field of that name, else the last digits of the URL.
    """
    rows = df.where(F.contains(F.col(kind), F.lit(wanted)))
    for f in required:
        rows = rows.where(blank(F.col(f)).isNotNull())
    own = F.col("detail_id").cast("string") if "detail_id" in df.columns else F.lit(None).cast("string")
    return rows.withColumn("detail_id", F.coalesce(own, blank(F.regexp_extract(url, r"(\d+)/?$", 1)))).withColumn("species", F.explode(integers_in(F.col(number), low, high)))


def catalog_stats(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Cards and distinct species of each written partition."""
    return df.groupBy(*by).agg(F.count("*").alias("n_cards"), F.countDistinct(key).alias("n_species"))


def write_version(spark: SparkSession, path: str) -> DataFrame:
    """A one-row version table, written after everything else."""
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("version"))
    stamp.write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.max("version").alias("version"))


def export_collection(df: DataFrame, user: str, fields: Sequence[str], version: int = 1) -> DataFrame:
    """One JSON document for each user."""
    return df.select(user, F.to_json(F.struct(F.lit(version).alias("version"), *fields)).alias("payload"))


def import_collection(df: DataFrame, payload: str, schema: T.StructType, version: int, defaults: dict[str, Column]) -> DataFrame:
    """Payloads with ``valid`` and their fields; a wrong version or shape is rejected, absent optional fields get defaults."""
    out = df.withColumn("_p", F.from_json(payload, schema)).withColumn("valid", F.coalesce(F.col("_p.version") == version, F.lit(False)))
    for f in schema.fieldNames():
        if f != "version":
            value = F.coalesce(F.col(f"_p.{f}"), defaults[f]) if f in defaults else F.col(f"_p.{f}")
            out = out.withColumn(f, F.when(F.col("valid"), value))
    return out.drop("_p")


def set_index(paths: DataFrame, path: str, depth: int, key: Column) -> DataFrame:
    """First path of each set id among those of one folder depth."""
    rows = paths.withColumn("set_id", key).where((F.size(F.split(path, "/")) == depth) & blank(F.col("set_id")).isNotNull())
    return rows.groupBy("set_id").agg(F.min(path).alias("path"))


def read_translation(spark: SparkSession, path: str | None) -> DataFrame:
    """Dictionary (field, source, target) from JSON; without a file it is empty, and nothing is translated."""
    schema = "field string, source string, target string"
    return spark.read.schema(schema).json(path) if path else spark.createDataFrame([], schema)


def slug_index(paths: DataFrame, path: str) -> DataFrame:
    """Card slug to set slug from the last two folder names of a path; slashes at its end don't count."""
    names = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return paths.select(F.coalesce(F.try_element_at(names, F.lit(-2)), F.lit("")).alias("set_slug"), F.element_at(names, -1).alias("card_slug"))
