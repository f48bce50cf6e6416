"""Helpers shared by the operators: written tables, row numbers, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, every later
    reader sees the same rows, and a lost executor costs none of them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that ``kept`` wrote, once what was made of them is written too."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stretches(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose texts or binaries have about ``size`` bytes, so that only one stretch of them
    need be Python objects at a time; a longer value ends its stretch."""
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= size:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def fresh_name(columns: Iterable[str], stem: str) -> str:
    """A column name that no given column has, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own and the key's column name, so that later steps tell repeated rows
    and rows without an id apart. Rows read from files are named by file and place in it, which every
    reader sees alike; any other frame is written once with a running number."""
    row = fresh_name(docs.columns, "row_key")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        place = F.concat(F.substring(F.md5("_metadata.file_path"), 1, 16), F.lit(":"), F.col("_metadata.row_index").cast("string"))
        try:
            return docs.select("*", place.alias(row)), row
        except AnalysisException:  # a source without row numbers
            pass
    return kept(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b), which are longs.

    Each round orders the nodes afresh by a hash, lets every node join the first of its
    neighbourhood, and contracts the edges; a constant share of the nodes goes each round, whatever
    the shape. Minima are combined before the shuffle, so a node with very many edges is no hot task.
    """
    edges = kept(edges.select("a", "b").filter("a != b").distinct(), "edges")
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        turn = F.lit(len(parents))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("n"))
        parent = kept(first.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("root")), "parents")
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").filter("ra != rb")
        edges = kept(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        parents.append(parent)
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = parents[0]
    for p in parents[1:]:
        step = p.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = out.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return out
