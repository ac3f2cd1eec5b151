"""CSV, parquet and JSON sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from lotwise.config import RAW_LISTING_COLUMNS


def text_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_reader(spark: SparkSession, columns: Iterable[str], header: bool, line_breaks: bool) -> DataFrameReader:
    """Text columns, fields in double quotes, a quote inside them doubled. With `line_breaks` a quoted field may hold line
    breaks; Spark then reads a file in one task, so leave it off for large files known to have none."""
    return (
        spark.read.schema(text_schema(columns)).option("header", header)
        .option("quote", '"').option("escape", '"').option("multiLine", line_breaks)
    )


def read_listings(
    spark: SparkSession, path: str, columns: Sequence[str] = RAW_LISTING_COLUMNS, on_error: str = "fail",
    line_breaks: bool = True,
) -> DataFrame:
    """All CSV files of a folder or glob stacked, every column text.

    `fail` stops at a file whose header differs; `skip` leaves such files out
    (`read_validated` also names them).
    """
    if on_error == "skip":
        return read_validated(spark, path, columns, line_breaks)[0]
    return (
        csv_reader(spark, columns, True, line_breaks).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    )


def read_with_rejects(
    spark: SparkSession, path: str, columns: Sequence[str], header: bool = True, line_breaks: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows that do not fit the schema with their text); unreadable files are skipped."""
    rows = (
        csv_reader(spark, [*columns, "_bad"], header, line_breaks)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("ignoreCorruptFiles", True)
        .csv(path)
    )
    # Every column has to be parsed for a row to be judged, whatever is selected later.
    judged = rows.where(F.length(F.concat_ws("", *columns)) >= 0)
    return judged.where("_bad is null").drop("_bad"), judged.where("_bad is not null")


# What is read of a file to see its first line.
HEADER_BYTES = 65_536
# Files that are opened at a time.
PROBES = 32


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the plain files in a folder, or that a glob names; the sources themselves pass over empty ones.
    Folders that the glob names are opened, as the sources do. The driver sees names and sizes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(path)
    system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matched = system.globStatus(pattern)
    if not matched:
        raise FileNotFoundError(path)
    found = []
    for status in matched:
        for file in system.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if file.isFile() and not file.getPath().getName().startswith(("_", ".")):
                found.append((file.getPath().toString(), file.getLen()))
    return spark.createDataFrame(found, "path string, bytes bigint")


def probe_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, header): first line of every file, null for an empty one.

    Opens each listed file once, PROBES at a time, and reads its first block of HEADER_BYTES (more only if the line is
    longer). The driver sees one line per file, as it sees the listing; no content is scanned.
    """
    files = list_files(spark, path)
    jvm = spark.sparkContext._jvm
    configuration = spark.sparkContext._jsc.hadoopConfiguration()

    def first_line(name: str, size: int) -> str | None:
        if not size:
            return None
        file = jvm.org.apache.hadoop.fs.Path(name)
        stream = file.getFileSystem(configuration).open(file)
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"), HEADER_BYTES)
            return reader.readLine()
        finally:
            stream.close()

    listed = files.collect()
    with ThreadPoolExecutor(PROBES) as pool:
        headers = list(pool.map(lambda r: first_line(r.path, r.bytes), listed))
    rows = [(r.path, r.bytes, header) for r, header in zip(listed, headers, strict=True)]
    return spark.createDataFrame(rows, "path string, bytes bigint, header string")


def read_validated(
    spark: SparkSession, path: str, required: Sequence[str], line_breaks: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows of all files that have the required columns, skipped files with the reason).

    Columns are taken by name, so files may order them differently. The driver
    sees one header line per file, as it sees the file listing, and no data.
    """
    names = F.transform(F.split("header", ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    probed = probe_headers(spark, path).withColumn("columns", names)
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), "columns")
    reason = (
        F.when(F.col("header").isNull(), "empty file")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    )
    judged = probed.withColumn("reason", reason)
    skipped = judged.where("reason is not null").select("path", "reason")
    layouts = (
        judged.where("reason is null")
        .groupBy("columns").agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .collect()
    )
    parts = [
        csv_reader(spark, row["columns"], True, line_breaks).csv(row["paths"]).select(*required)
        for row in sorted(layouts, key=lambda r: r["paths"][0])
    ]
    if not parts:
        return spark.createDataFrame([], text_schema(required)), skipped
    return union_all(*parts), skipped


def read_ragged(
    spark: SparkSession, path: str, columns: Sequence[str], header: bool = True, line_breaks: bool = True
) -> DataFrame:
    """CSV whose surplus fields are cut and whose missing fields are null."""
    return csv_reader(spark, columns, header, line_breaks).option("mode", "PERMISSIVE").csv(path)


def write_versioned(df: DataFrame, path: str, tag: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet below '<path>_<tag>'; the path is returned."""
    target = f"{path}_{tag}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return target


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_metrics(df: DataFrame, path: str, **labels: str) -> str:
    """Append metric rows, with their labels, as JSON lines."""
    df.withColumns({k: F.lit(v) for k, v in labels.items()}).write.mode("append").json(path)
    return path


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def save_vocabulary(df: DataFrame, col: str, path: str) -> str:
    vocabulary(df, col).select(F.col(col).cast("string")).write.mode("overwrite").text(path)
    return path


def load_vocabulary(spark: SparkSession, path: str, col: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", col)


def tag_snapshot(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("snapshot", F.lit(name))


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack frames of equal columns, by name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def add_block(df: DataFrame, block: Sequence[Column]) -> DataFrame:
    """A block of features beside the columns of the same row."""
    return df.select("*", *block)


def drop_header_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows in which a repeated header line stands as data."""
    return df.where(F.col(col) != F.lit(col))


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename the first alias found to each canonical name; complain about all absent ones at once."""
    chosen = {
        name: next((a for a in (name, *options) if a in df.columns), None)
        for name, options in aliases.items()
    }
    absent = sorted(name for name, found in chosen.items() if found is None)
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.withColumnsRenamed({found: name for name, found in chosen.items() if found != name})


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return resolve_columns(df, {c: () for c in columns})
