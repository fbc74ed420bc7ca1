"""Registered queries and what they share: tables as triples, and a shared place for files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workload import BASE

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}
TRIPLE, QUAD = "s string, p string, o string", "g string, s string, p string, o string"
INTEGER = "http://www.w3.org/2001/XMLSchema#integer"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Keep a query under its name, with the same in SQL."""

    def keep(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(kind: str, col: str) -> Column:
    return F.concat(F.lit(f"<{BASE}{kind}/"), F.col(col).cast("string"), F.lit(">"))


def text(col: str) -> Column:
    return F.concat(F.lit('"'), F.col(col).cast("string"), F.lit('"'))


def triples(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def rows(spark: SparkSession, *facts: tuple[str, str, str]) -> DataFrame:
    return spark.createDataFrame(list(facts), TRIPLE)


def workplace(spark: SparkSession) -> str:
    """A new folder for files, beside the checkpoints where a shared folder is set, and else (all tasks run here) a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster files need a shared folder")
    return f"{shared}/files-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="loom-files-")


def one_file(lines: DataFrame, path: str, head: str = "") -> str:
    """Lines of text as one file of a given name, ``head`` first: written by all tasks, and their parts strung together as streams."""
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    lines.write.mode("overwrite").text(f"{path}.parts")
    folder, whole = jvm.org.apache.hadoop.fs.Path(f"{path}.parts"), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda part: part.getName())
    out = fs.create(whole, True)
    try:
        out.write(bytearray(head, "utf-8"))
        for part in parts:
            source = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(folder, True)
    return path
