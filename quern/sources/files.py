"""Readers and writers of corpus files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS_PER_SHARD = 20_000


def jsonl_complete(spark: SparkSession, path: str, schema: str, final: bool = False) -> DataFrame:
    """Complete lines of JSONL files that may still grow: what follows the last line end is left out, unless the file is final
    and the rest is valid JSON. Lines that aren't JSON come out as nulls of the schema.

    Whether the last line ended is told by the file's size against the bytes of its lines; no file is loaded as a whole."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("__at"))
    ends = lines.groupBy("file").agg(F.max("__at").alias("last"), (F.sum(F.octet_length("value") + 1) > F.max("bytes")).alias("torn"))
    torn = F.col("torn") & (F.col("__at") == F.col("last"))
    keep = ~torn | (F.try_parse_json("value").isNotNull() if final else F.lit(False))
    return lines.join(ends, "file").where(keep & (F.trim("value") != "")).select(F.from_json("value", schema).alias("r")).select("r.*")


def parquet_projection(spark: SparkSession, paths: list[str], columns: list[str], fallback_id: str = "id") -> DataFrame:
    """Only the columns asked for; a null id falls back to the file's name and the row's hash."""
    df = spark.read.parquet(*paths)
    file = F.col("_metadata.file_name")
    picked = [F.coalesce(F.col(c).cast("string"), F.concat_ws("#", file, F.xxhash64(*[F.col(x).cast("string") for x in df.columns]).cast("string"))).alias(c) if c == fallback_id else F.col(c) for c in columns]
    return df.select(*picked)


def write_shards(df: DataFrame, path: str, split: str, docs_per_shard: int = DOCS_PER_SHARD) -> None:
    """JSONL shards, gzip, at most so many documents each, in a folder for the split."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", docs_per_shard).option("compression", "gzip").json(f"{path}/split={split}")


def read_shards(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/split={split}")


def export_partitioned(df: DataFrame, path: str, ts: str, domain: Column) -> None:
    """year=/month=/domain= folders; each partition is written by one task unless AQE splits it."""
    out = df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)).withColumn("domain", F.coalesce(domain, F.lit("general")))
    out.repartition("year", "month", "domain").write.mode("errorifexists").partitionBy("year", "month", "domain").parquet(path)


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested values as JSON strings, for sinks that hold flat tables."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema.fields])


def release(df: DataFrame, path: str) -> DataFrame:
    """Write an immutable release and return its manifest: file, bytes and SHA-256 of each part."""
    df.write.mode("errorifexists").parquet(path)
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_release(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a manifest."""
    now = manifest(spark, path).select("file", F.col("sha256").alias("is"))
    both = expected.select("file", F.col("sha256").alias("was")).join(now, "file", "full_outer")
    state = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("is") != F.col("was"), "changed")
    return both.select("file", state.alias("state")).where("state is not null")


def read_log(log: DataFrame, after: int, upto: int) -> DataFrame:
    """Entries with after < seq <= upto: the filter reaches the scan."""
    return log.where((F.col("seq") > after) & (F.col("seq") <= upto))


def numbered(entries: DataFrame, stream: str, order: list[Column], head: DataFrame | None = None) -> DataFrame:
    """A gap-free seq for each stream, going on from the heads (stream, head)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    if head is None:
        return entries.withColumn("seq", n.cast("bigint"))
    return entries.withColumn("__n", n).join(head, stream, "left").withColumn("seq", F.coalesce("head", F.lit(0)) + F.col("__n")).drop("__n", "head")


def sql_readonly(spark: SparkSession, query: str, limit: int = 200) -> tuple[DataFrame, bool]:
    """One SELECT or WITH statement, its first rows and whether there are more."""
    body = query.strip().rstrip(";").strip()
    head = body.split(None, 1)[0].lower() if body else ""
    if head not in ("select", "with") or ";" in body:
        raise ValueError("exactly one SELECT or WITH statement is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body).getClass().getSimpleName()
    if "Insert" in plan or "Create" in plan:
        raise ValueError("the statement changes tables")
    rows = spark.sql(body)
    return rows.limit(limit), rows.limit(limit + 1).count() > limit


def prometheus(lines: DataFrame, value: str = "value") -> DataFrame:
    """(metric, total): exposition lines summed over their labels; comments and NaN are left out."""
    m = r"^([A-Za-z_:][\w:]*)(?:\{[^}]*\})?\s+(\S+)(?:\s+\d+)?$"
    parsed = lines.select(F.regexp_extract(value, m, 1).alias("metric"), F.regexp_extract(value, m, 2).try_cast("double").alias("x"))
    return parsed.where((F.col("metric") != "") & F.col("x").isNotNull() & ~F.isnan("x")).groupBy("metric").agg(F.sum("x").alias("total"))


def source_rows(spark: SparkSession, kind: str, path: str, key: str, text: str) -> DataFrame:
    """(id, text, file) of files of a kind, read by the reader that READERS names for it; globs and folders are one source."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; there are {sorted(READERS)}")
    return READERS[kind](spark, path).select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col("_metadata.file_path").alias("file"))


READERS = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "jsonl": lambda spark, path: spark.read.json(path),
    "csv": lambda spark, path: spark.read.option("header", True).csv(path),
    "text": lambda spark, path: spark.read.option("wholetext", True).text(path),
}
