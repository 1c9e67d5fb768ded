"""Listing pairs of blank and filled forms by their file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The naming rule.
TEMPLATE, FILLED = "_TEMPLATE.pdf", "_EXECUTED_synthetic.pdf"


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, name, length) of files under a folder; contents are not read. A missing folder gives no rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, name string, length long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


def is_pdf(name: Column) -> Column:
    return name.rlike(r"(?i)\.pdf$")


def match_pairs(names: DataFrame) -> DataFrame:
    """(stem, template, filled): each template with all files named after its stem.

    The filled name's possible stems are cut at its underscores, so the prefix match is an equi-join on the stem.
    """
    templates = names.where(F.endswith(F.col("name"), F.lit(TEMPLATE))).select(F.col("name").alias("template"), F.replace("name", F.lit(TEMPLATE), F.lit("")).alias("stem"))
    middle = F.expr(f"substring(name, 1, length(name) - {len(FILLED)})")
    filled = names.where(F.endswith(F.col("name"), F.lit(FILLED))).select(F.col("name").alias("filled"), middle.alias("m"))
    words = F.split("m", "_")
    stems = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), "_"))
    exploded = filled.where(F.size(words) > 1).select("filled", F.explode(stems).alias("stem"))
    return templates.join(exploded, "stem").select("stem", "template", "filled")
