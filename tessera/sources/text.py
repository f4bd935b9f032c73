"""Text formats: edge lists, partitions, features, labels, layer sizes, and the tables of the comparison systems."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(pos, line): lines of a file, or of the files of a folder by name, numbered from 0; with keep only the lines it
    holds for count.

    Blocks count their lines, those counts (one row a block) are run over in file order, then lines are numbered inside
    their block."""
    d = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id")
    )
    if keep is not None:
        d = d.where(keep)
    blocks = d.groupBy("_file", "_at").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_file", "_at").orderBy("_id")) - 1
    return d.join(blocks, ["_file", "_at"]).select((F.col("_base") + inside).alias("pos"), "line")


def read_edges(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """(src, dst) of a text edge list; # and % start comments, blank lines don't count, self edges stay.

    on_error: "fail" raises at a line that is no pair of ids; "drop" leaves it out; "stop" takes nothing from the first
    such line on."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")) if on_error != "stop" else numbered_lines(spark, path).select("pos", F.trim("line").alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike("^[#%]"))
    pair = r"^(\d+)[\s,]+(\d+)(?:\s.*)?$"
    fine = F.col("line").rlike(pair)
    if on_error == "drop":
        lines = lines.where(fine)
    elif on_error == "stop":
        first = lines.where(~fine).agg(F.min("pos").alias("bad"))
        lines = lines.join(F.broadcast(first)).where(F.col("bad").isNull() | (F.col("pos") < F.col("bad")))  # one row
    else:
        bad = F.raise_error(F.concat(F.lit("no edge: "), F.col("line"))).cast("string")
        lines = lines.select(F.when(fine, F.col("line")).otherwise(bad).alias("line"))
    return lines.select(F.regexp_extract("line", pair, 1).cast("long").alias("src"), F.regexp_extract("line", pair, 2).cast("long").alias("dst"))


def edge_summary(edges: DataFrame) -> DataFrame:
    """One row: n_vertices = largest id + 1 over all lines, n_edges without self edges."""
    return edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("n_vertices"), F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("n_edges"))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(vid, part): one partition a line; lines that don't start with a digit are no vertices."""
    lines = numbered_lines(spark, path, F.col("line").rlike(r"^\d"))
    return lines.select(F.col("pos").alias("vid"), F.regexp_extract("line", r"^(\d+)", 1).cast("int").alias("part"))


def write_ordered(df: DataFrame, key: str, value: str, path: str) -> None:
    """One line a row in the order of key: range-partitioned, so files in name order are the whole in order."""
    df.orderBy(key).select(F.col(value).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(vid, feat): numbers by commas or blanks; negative first values count like any other."""
    lines = numbered_lines(spark, path, F.col("line").rlike(r"^\s*[-+.\d]"))
    parts = F.filter(F.split(F.trim("line"), r"[\s,]+"), lambda x: x != "")
    return lines.select(F.col("pos").alias("vid"), F.transform(parts, lambda x: x.cast("float").cast("double")).alias("feat"))


def feature_lines(x: DataFrame, sep: str = ",") -> DataFrame:
    return x.select("vid", F.array_join(F.transform("feat", lambda v: v.cast("float").cast("string")), sep).alias("line"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path, F.col("line").rlike(r"^\d"))
    return lines.select(F.col("pos").alias("vid"), F.regexp_extract("line", r"^(\d+)", 1).cast("int").alias("label"))


def read_layers(path: str) -> list[int]:
    """Layer sizes, one a line, at least two."""
    sizes = [int(x) for x in Path(path).read_text().split()]
    if len(sizes) < 2:
        raise ValueError("a model needs at least two layer sizes")
    return sizes


def node_table(vertices: DataFrame) -> DataFrame:
    """(id, label, feature): the features joined by colons."""
    return vertices.select(F.col("vid").alias("id"), "label", F.array_join(F.transform("feat", lambda v: v.cast("float").cast("string")), ":").alias("feature"))


def edge_table(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src_id, dst_id, weight): distinct edges with a self loop for every vertex, weight 1."""
    loops = vertices.select(F.col("vid").alias("src"), F.col("vid").alias("dst"))
    return edges.select("src", "dst").unionByName(loops).distinct().select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit(1.0).alias("weight"))


def mask_table(splits: DataFrame, name: str) -> DataFrame:
    return splits.where(F.col("split") == name).select(F.col("vid").alias("id"), F.lit(1.0).cast("float").alias("weight"))


def write_tab(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def type_masks(vertices: DataFrame, node_type: str = "node_type") -> DataFrame:
    """train, val and test masks of node types 1, 2 and 3."""
    return vertices.withColumns({n: F.coalesce(F.col(node_type) == k, F.lit(False)) for k, n in ((1, "train"), (2, "val"), (3, "test"))})


def read_weight_dump(lines: DataFrame) -> DataFrame:
    """lines (i, line) of a dumped matrix -> (i, j, val)."""
    parts = F.filter(F.split("line", r"[\s,]+"), lambda x: x != "")
    return lines.select("i", F.posexplode(parts).alias("j", "val")).select("i", "j", F.col("val").cast("double").alias("val"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_run_summary(run, path: str) -> None:
    Path(path).write_text(json.dumps({"epochs": run.metrics, "state": run.state.name}, indent=1))
