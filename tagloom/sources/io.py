"""Reading records and sidecars, and writing results."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import norm

IMAGES = ("jpg", "jpeg", "png", "webp")
#: What starts the metadata line of a tag file; suffixes of sidecars, longest first.
SUFFIXES = (".review.json", ".combined.txt", ".short.txt", ".long.txt", ".combined", ".layout", ".short", ".long", ".json", ".tag", ".txt", ".csv")
MARKER = "# metadata:"


def _stem(name: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.regexp_replace(name, r"\.[^.]*$", "")
    for s in sorted(suffixes, key=len):
        out = F.when(F.endswith(F.lower(name), F.lit(s)), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return F.lower(out)


def bundle_files(files: DataFrame) -> DataFrame:
    """(folder, record_id, names) of files (folder, name): images and sidecars that share a stem, without case.

    The longest known suffix is cut off, unless an image has the longer stem itself.
    """
    image = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*IMAGES)
    df = files.withColumn("_image", image).withColumn("_plain", F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))).withColumn("_stem", F.when(F.col("_image"), F.col("_plain")).otherwise(_stem(F.col("name"), SUFFIXES)))
    stems = df.where("_image").select("folder", F.col("_plain")).distinct().withColumn("_own", F.lit(True))
    df = df.join(stems, ["folder", "_plain"], "left").withColumn("record_id", F.when(F.col("_own"), F.col("_plain")).otherwise(F.col("_stem")))
    return df.groupBy("folder", "record_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def stem_conflicts(files: DataFrame) -> DataFrame:
    """Images (folder, name) of one folder that share a stem, and so a sidecar."""
    df = files.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*IMAGES)).withColumn("stem", F.lower(F.regexp_replace("name", r"\.[^.]*$", "")))
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("folder", "stem"))).where("_n > 1").select("folder", "name", "stem")


def read_source_tags(c: Column) -> Column:
    """The comma tags before the metadata line, trimmed, blanks gone."""
    return F.filter(F.transform(F.split(F.substring_index(c, "\n" + MARKER, 1), ","), lambda t: norm.strip(t)), lambda t: t != "")


def read_source_metadata(c: Column) -> Column:
    """A0d: the object of the first metadata line after line 1 as map<string,string>; null if it is none."""
    line = F.get(F.filter(F.split(c, r"\r?\n"), lambda x, i: (i > 0) & F.startswith(x, F.lit(MARKER))), F.lit(0))
    text = F.trim(F.right(line, F.length(line) - len(MARKER)))
    return F.when(F.startswith(text, F.lit("{")), F.from_json(text, "map<string,string>"))


def is_source_tag_file(name: Column) -> Column:
    """A0e: a `.txt` file that is no caption text."""
    return F.lower(name).rlike(r"\.txt$") & ~F.lower(name).rlike(r"\.(long|short|combined)\.txt$")


def read_dataset_tags(c: Column) -> Column:
    """A0f: the set of tags of a text: lines before the metadata line that are no comments, cut at commas, sorted."""
    lines = F.split(c, r"\r\n|\r|\n")
    at = F.array_position(F.transform(lines, lambda x: F.startswith(norm.strip(x), F.lit(MARKER))), True)
    body = F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)
    used = F.filter(body, lambda x: ~F.startswith(norm.strip(x), F.lit("#")))
    tags = F.transform(F.split(F.array_join(used, "\n"), r"[,\r\n]+"), lambda t: norm.normalize_tag(t, "stats"))
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t != "")))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A0g: the first data row of every CSV file, text columns with normal header names, unknown columns kept."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    first = df.select("*", F.col("_metadata.file_path").alias("_file"))
    first = first.withColumn("_i", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy("_i"))).where("_n = 1")
    return norm.normalize_headers(first.drop("_n", "_i", "_file"))


def with_origin(df: DataFrame) -> DataFrame:
    """A file scan with file and row of every row, in that order the precedence of lookups."""
    return df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def read_lookup_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The given columns of all Parquet files of a folder, with `_file` and `_row`.

    Files may have other schemas. A column that a file lacks is null in its rows, so that files without a key or a text give
    nothing. Spark reads all footers in one job; only if they don't agree on the columns' types are they looked at one by one, and
    files in which a column has another type are left out. An empty folder gives no rows.
    """
    wanted = spark.createDataFrame([], schema).schema
    fits = lambda found: all(found[f.name].dataType == f.dataType for f in wanted.fields if f.name in found.names)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    if listed.select("path").isEmpty():
        return spark.createDataFrame([], f"{schema}, _file string, _row long")
    try:
        agree = fits(spark.read.option("mergeSchema", True).parquet(path).schema)
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE" not in (str(error.java_exception) if isinstance(error, Py4JJavaError) else str(error)):
            raise
        agree = False
    if agree:
        return with_origin(spark.read.schema(wanted).parquet(path))
    usable = [r.path for r in listed.select("path").collect() if fits(spark.read.parquet(r.path).schema)]
    if not usable:
        return spark.createDataFrame([], f"{schema}, _file string, _row long")
    return with_origin(spark.read.schema(wanted).parquet(*usable))


def export_training_text(df: DataFrame, kinds: tuple[str, ...] = ("combined", "long", "short", "tag")) -> DataFrame:
    """A0i: (kind, name, content) of accepted records (record_id, a column per kind), a row for each text that is there."""
    present = [F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.concat(F.col("record_id").cast("string"), F.lit(f".{k}")).alias("name"), F.col(k).alias("content"))) for k in kinds]
    return df.select(F.explode(F.array_compact(F.array(*present))).alias("x")).select("x.*")


def write_training_text(df: DataFrame, path: str) -> None:
    export_training_text(df).write.partitionBy("kind").parquet(path)


def export_tag_stats(df: DataFrame, path: str) -> None:
    """A0j: statistics as CSV with a header."""
    df.write.option("header", True).csv(path)


def export_candidates(df: DataFrame, path: str) -> None:
    """A0k: candidates as lines of JSON."""
    df.write.json(path)


def candidate_tags_text(names: DataFrame) -> DataFrame:
    """A0k: one row with all distinct names as an escaped comma line, in order: a display of hand-picked names."""
    return names.select("name").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda n: norm.escape_parentheses(n)), ", ").alias("line"))


def write_missing(df: DataFrame, target: DataFrame, key: str = "record_id") -> DataFrame:
    """A0l: the rows to append: those whose key the target lacks."""
    return df.join(target.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """A0m: the table after writing new over old: replace, ignore (old stays), or fill_blank (old stays where filled)."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_new"))
    df = o.join(n, keys, "full_outer")

    def pick(c: str) -> Column:
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if mode == "replace":
            return F.when(F.col("_new"), b).otherwise(a)
        if mode == "ignore":
            return F.when(F.col("_old"), a).otherwise(b)
        if mode == "fill_blank":
            return F.when(F.col("_old").isNull() | F.coalesce(F.trim(a.cast("string")) == "", F.lit(True)), F.coalesce(b, a)).otherwise(a)
        raise ValueError(f"unknown mode {mode}")

    return df.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def delete_keys(df: DataFrame, keys: DataFrame, col: str = "tag") -> DataFrame:
    """A0n: without all spellings of some tags (tag)."""
    spellings = keys.select(F.explode(norm.candidate_keys(F.col("tag"))).alias(col)).distinct()
    return df.join(spellings, col, "left_anti").select(*df.columns)
