"""Whitespace text sources: graphs, update streams and patterns.

Lines: `v id label` and `e source target label`; in streams also `-v` and `-e`. CRLF, trailing
blanks and a missing final newline are accepted; any other first token raises.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut
from weftgraph.plans.pattern import SYMMETRIC_LABELS, Pattern


def _tokens(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).where("line <> ''")
    return lines.select("line", F.split("line", " ").alias("t"))


def _checked(ok, line) -> F.Column:
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a graph line: "), line)))


def read_vertices(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id, label of the `v` lines."""
    t = _tokens(spark, paths)
    good = ((F.col("t")[0] == "v") & (F.size("t") == 3)) | ((F.col("t")[0] == "e") & (F.size("t") == 4))
    return t.where(_checked(good, F.col("line"))).where(F.col("t")[0] == "v").select(F.col("t")[1].cast("long").alias("id"), F.col("t")[2].cast("int").alias("label"))


def read_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """src, dst, label of the `e` lines."""
    t = _tokens(spark, paths)
    good = ((F.col("t")[0] == "v") & (F.size("t") == 3)) | ((F.col("t")[0] == "e") & (F.size("t") == 4))
    return t.where(_checked(good, F.col("line"))).where(F.col("t")[0] == "e").select(*(F.col("t")[i + 1].cast("long" if i < 2 else "int").alias(c) for i, c in enumerate(("src", "dst", "label"))))


def read_updates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """seq (line order from 1, over the files in order of their names), kind (v or e), op (1 or -1), id1, id2 (null for v), label.

    Files are read in splits. A line's number is the count of the lines in earlier splits, of which
    there is one row each, plus its place in its own; the numbers are fixed by cutting lineage.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")
    )
    # lines of a split follow each other in a partition, so these ids grow in file order within it
    placed = cut(lines.where("line <> ''").withColumn("place", F.monotonically_increasing_id()))
    splits = placed.groupBy("file", "at").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, 0)
    offsets = splits.select("file", "at", (F.sum("n").over(upto) - F.col("n") - F.col("low") + 1).alias("shift"))
    numbered = placed.join(offsets, ["file", "at"])
    t = numbered.select((F.col("place") + F.col("shift")).alias("seq"), "line", F.split("line", " ").alias("t"))
    kind = F.regexp_replace(F.col("t")[0], "^-", "")
    good = ((kind == "v") & (F.size("t") == 3)) | ((kind == "e") & (F.size("t") == 4))
    return t.where(_checked(good, F.col("line"))).select(
        "seq",
        kind.alias("kind"),
        F.when(F.col("t")[0].startswith("-"), -1).otherwise(1).alias("op"),
        F.col("t")[1].cast("long").alias("id1"),
        F.when(kind == "e", F.get("t", F.lit(2)).cast("long")).alias("id2"),
        F.element_at("t", -1).cast("int").alias("label"),
    )


def graph_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """value: the text lines of vertices(id, label) and edges(src, dst, label)."""
    v = vertices.select(F.concat_ws(" ", F.lit("v"), "id", "label").alias("value"))
    return v.unionByName(edges.select(F.concat_ws(" ", F.lit("e"), "src", "dst", "label").alias("value")))


def update_line() -> F.Column:
    """The text line of an update."""
    sign = F.concat(F.when(F.col("op") < 0, "-").otherwise(""), F.col("kind"))
    return F.concat_ws(" ", sign, F.col("id1"), F.col("id2"), F.col("label"))


def parse_pattern(text: str, name: str, symmetric: frozenset[int] = SYMMETRIC_LABELS) -> Pattern:
    pattern = Pattern(name, symmetric=symmetric)
    vertices, edges = {}, []
    for line in text.splitlines():
        t = line.split()
        if not t:
            continue
        if t[0] == "v" and len(t) == 3:
            vertices[int(t[1])] = int(t[2])
        elif t[0] == "e" and len(t) == 4:
            edges.append(tuple(map(int, t[1:])))
        else:
            raise ValueError(f"{name}: not a pattern line: {line!r}")
    if sorted(vertices) != list(range(len(vertices))):
        raise ValueError(f"{name}: vertex ids must be 0, 1, 2, ...")
    for v in sorted(vertices):
        pattern.add_vertex(vertices[v])
    for e in edges:
        pattern.add_edge(*e)
    return pattern


def _natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def read_patterns(spark: SparkSession, folder: str, symmetric: frozenset[int] = SYMMETRIC_LABELS) -> list[Pattern]:
    """The pattern files below a folder that Spark reads, in natural order of their paths; the driver gets their few lines."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()
    found = sorted(((r["path"], r["value"]) for r in files), key=lambda x: _natural(x[0]))
    return [parse_pattern(text, path.rsplit("/", 1)[-1].split(".")[0], symmetric) for path, text in found]


def pattern_text(p: Pattern) -> str:
    """The text of a pattern file."""
    return "\n".join([f"v {i} {x}" for i, x in enumerate(p.labels)] + [f"e {e.src} {e.dst} {e.label}" for e in p.edges])


def load_patterns(folder: str, symmetric: frozenset[int] = SYMMETRIC_LABELS) -> list[Pattern]:
    """The pattern files of a folder in natural order of their names."""
    return [parse_pattern(p.read_text(), p.stem, symmetric) for p in sorted((p for p in Path(folder).iterdir() if p.is_file()), key=lambda p: _natural(p.name))]
