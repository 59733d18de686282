"""Raw multi-file CSV in, one clean typed table out."""

from __future__ import annotations

import csv
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.functions.scalars import clean_label, finite_or_null, to_number
from flowlab.tables import local_table, ref

FILE_COLUMN = "source_file"


def read_flow_csv(spark, paths, encoding="ISO-8859-1"):
    """Read CSV files with a header as text columns, plus the file path of every row.

    Columns are read by position, so a header that occurs twice cannot disturb its
    twin; names are trimmed and only the first of two equal names is kept. Files
    whose headers differ are matched by name, also those of one folder: one read of
    the lines finds the header of every file."""
    by_header = defaultdict(list)
    for line, files in header_lines(spark, paths, encoding):
        by_header[tuple(c.strip() for c in next(csv.reader([line])))] += files
    out = None
    for names, group in by_header.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.csv(group, schema=schema, header=True, encoding=encoding,
                             enforceSchema=True, mode="PERMISSIVE")
        kept = {}
        for i, name in enumerate(names):
            kept.setdefault(name, f"c{i}")
        part = raw.select(*[F.col(c).alias(name) for name, c in kept.items()],
                          F.col("_metadata.file_path").alias(FILE_COLUMN))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def header_lines(spark, paths, encoding):
    """(first line, paths of the files that start with it), one per different line."""
    lines = spark.read.csv(list(paths), schema="line string", header=False, encoding=encoding,
                           sep=chr(1), quote=chr(2))
    starts = lines.select("line", F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.file_block_start").alias("start"),
                          F.monotonically_increasing_id().alias("place")).where("start = 0")
    first = starts.groupBy("file").agg(F.min_by("line", "place").alias("line"))
    return [(r["line"], sorted(r["files"]))
            for r in first.groupBy("line").agg(F.collect_list("file").alias("files")).orderBy("line").collect()]


def trim_columns(df):
    """Strip blanks from column names; of equal names the first column stays."""
    kept = {}
    for i, name in enumerate(df.columns):
        kept.setdefault(name.strip(), i)
    by_position = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_position.select(*[F.col(f"c{i}").alias(n) for n, i in kept.items()])


def tag_source(df, sources, name="day"):
    """Name of the source a row came from. ``sources``: {source: (file paths...)}."""
    rows = [(file, source) for source, files in sources.items() for file in files]
    table = local_table(df.sparkSession, rows, f"_file string, {name} string")
    return df.join(table, ref(FILE_COLUMN) == F.col("_file"), "left").drop("_file")


def clean_flows(df, label, features, keep=()):
    """Numbers from text, infinities and bad text to NULL, clean labels, 4-byte floats."""
    numbers = [finite_or_null(to_number(ref(c))).cast("float").alias(c) for c in features]
    return df.select(*numbers, clean_label(ref(label)).alias(label), *[ref(c) for c in keep])


def expected_sources(spark, sources):
    """{source: (preferred name, other name...)} as source, place, name rows."""
    rows = [(s, i, n) for s, names in sources.items() for i, n in enumerate(names)]
    return local_table(spark, rows, "source string, place int, name string")


def files_below(spark, path, pattern="*"):
    """Path, name and size of the files below a folder; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(path))
    return files.select(F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_name").alias("name"),
                        F.col("_metadata.file_size").alias("bytes"))


def source_check(spark, sources, path):
    """Which file serves which source, and its size in MB; of files with the same name
    in several folders the first folder counts."""
    from flowlab.operators.audit import complete_sources

    files = files_below(spark, path)
    hits = complete_sources(expected_sources(spark, sources), files)
    sizes = files.groupBy("name").agg(F.min_by("bytes", "path").alias("bytes"))
    return hits.join(sizes, "name", "left").select(
        "source", "name", (F.col("bytes") / 1e6).alias("mb"))


def write_clean(df, path):
    """Snappy Parquet; copies-kept and copies-removed tables go to different paths."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def size_summary(spark, csv_path, parquet_path):
    """Megabytes before and after, and the shape of the result."""
    table = spark.read.parquet(parquet_path)
    raw = files_below(spark, csv_path, "*.csv").agg(F.sum("bytes").alias("b"))
    parquet = files_below(spark, parquet_path, "*.parquet").agg(F.sum("bytes").alias("b"))
    return table.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(table.columns)).alias("columns"),
        (raw.select("b").scalar() / 1e6).alias("csv_mb"),
        (parquet.select("b").scalar() / 1e6).alias("parquet_mb"))
