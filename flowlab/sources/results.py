"""Result tables and text reports on disk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


def write_runs(df, path, fmt="csv"):
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)
    return path


def read_runs(spark, path, schema=None, fmt="csv"):
    if fmt != "csv":
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, schema=schema)


def write_summary_tables(tables, folder):
    """One Parquet folder per named table; returns {name: path}."""
    paths = {}
    for name, table in tables.items():
        paths[name] = f"{folder}/{name}"
        table.write.mode("overwrite").parquet(paths[name])
    return paths


def write_report_texts(reports, path):
    """One text per row (report, text), filed under its report name."""
    reports.select("report", "text").write.mode("overwrite").partitionBy("report").text(path)
    return path


def read_report_texts(spark, path):
    """All reports below a folder, one row each."""
    return spark.read.text(path, wholetext=True).select(
        F.col("report").cast("string").alias("report"), F.col("value").alias("text"))


def _count(text):
    return F.regexp_replace(text, ",", "").try_cast("bigint")


def _report_lines(reports):
    """The lines of audit texts (the layout of ``audit.class_report_texts``): report, section (the
    title line above), indent, body and its words."""
    lines = reports.select("report", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    title = F.when(F.col("line").startswith("["), F.substring_index("line", "]", 1))
    above = Window.partitionBy("report").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    body = F.trim("line")
    return lines.select("report", F.last(title, ignorenulls=True).over(above).alias("section"),
                        (F.length("line") - F.length(F.ltrim("line"))).alias("indent"), body.alias("body"),
                        F.split(body, " +").alias("words"))


def _without_last(text):
    """A line's text before its last word."""
    return F.rtrim(F.left(text, F.length(text) - F.length(F.element_at(F.split(text, " +"), -1))))


def _behind(word, by=1):
    """The word that stands ``by`` places behind a given one, else NULL."""
    place = F.array_position("words", word)
    return F.when(place > 0, F.get("words", (place - 1 + by).cast("int")))


def parse_report_classes(reports):
    """Per class: copies removed (section 4) and rows kept (section 5) from audit report texts.

    A class line of section 4 is indented deeper than its sum and ends with a count; one of
    section 5 ends with a count and a share."""
    lines = _report_lines(reports)
    gone = lines.where("section = '[4' AND indent > 4").select(
        "report", _without_last(F.col("body")).alias("class"), _count(F.element_at("words", -1)).alias("removed"))
    kept = lines.where((F.col("section") == "[5") & F.col("body").endswith("%")).select(
        "report", _without_last(_without_last(F.col("body"))).alias("class"),
                       _count(F.element_at("words", -2)).alias("kept"))
    return kept.join(gone, ["report", "class"], "left").select(
        "report", "class", F.coalesce("removed", F.lit(0)).alias("removed"), "kept")


def parse_report_totals(reports):
    """Total rows, classes, ratio and overall copies from audit report texts."""
    copies = F.col("section").eqNullSafe("[4")
    return _report_lines(reports).groupBy("report").agg(
        F.max(F.when(F.get("words", F.lit(0)) == "TOTAL", _count(_behind("TOTAL")))).alias("total"),
        F.max(_count(_behind("classes:"))).alias("classes"),
        F.max(_count(_behind("ratio:"))).alias("ratio"),
        F.max(F.when(copies, _count(_behind("of", -1)))).alias("removed"),
        F.max(F.when(copies, _count(_behind("of")))).alias("raw"))
