"""Readers and writers of RDF files and snapshots, and the SSSOM mapping table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..parser.rdf import FORMATS, Malformed, parse_line
from ..store import SCHEMA
from ..terms import ntriples_column
from .documents import read_documents

_ARROW = pa.schema([("g", pa.string()), ("s", pa.string()), ("p", pa.string()), ("o", pa.string())])


def read_lines(spark: SparkSession, path: str | list[str], named: bool) -> DataFrame:
    """N-Triples or N-Quads: split by lines, parsed where they lie. ``named`` keeps a fourth term.

    Blank nodes are of their file, whose hash becomes part of their label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                quad = parse_line(line)
                if quad:
                    if not named and quad[0] is not None:
                        raise Malformed("a fourth term in N-Triples")
                    rows.append([f"_:f{number & 0xFFFFFFFFFFFFFFFF:x}.{t[2:]}" if t is not None and t.startswith("_:") else t for t in quad])
            yield pa.RecordBatch.from_pylist([dict(zip("gspo", q, strict=True)) for q in rows], schema=_ARROW)

    return spark.read.text(path).select("value", F.xxhash64(F.input_file_name()).alias("number")).mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, form: str | None = None, base: str = "") -> DataFrame:
    """Quads of a file, by its ending: .nt .nq .trig, and else Turtle."""
    form = form or (path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "ttl")
    how = FORMATS.get(form, "turtle")
    if how == "lines":
        return read_lines(spark, path, named=form in ("nq", "nquads"))
    return read_documents(spark, path, how, base)


def found_files(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The files among paths and below folders, by format."""
    out: dict[str, list[str]] = {}
    for path in paths:
        form = path.rsplit(".", 1)[-1].lower()
        if form in FORMATS:
            out.setdefault(form, []).append(path)
            continue
        for form in ("nt", "nq", "ttl", "trig"):
            found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{form}").option("recursiveFileLookup", "true").load(path).select("path")
            names = sorted(r["path"] for r in found.collect())
            if names:
                out.setdefault(form, []).extend(names)
    return out


def read_each(spark: SparkSession, names: dict[str, list[str]]) -> DataFrame:
    """The quads of files, one scan a format however many files there are; repeats stay."""
    parts = []
    for form, own in names.items():
        how = FORMATS.get(form, "turtle")
        parts.append(read_lines(spark, own, form in ("nq", "nquads")) if how == "lines" else read_documents(spark, own, how))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files and folders (all .nt, .nq, .ttl and .trig below them) as one set of quads."""
    return read_each(spark, found_files(spark, paths)).distinct()


def file_path(source: str) -> str:
    """The path of a ``file:`` IRI; other schemes are refused."""
    parts = urlparse(source)
    if parts.scheme != "file":
        raise Malformed(f"only file: sources are loaded, not {source}")
    return unquote(parts.path)


def write_lines(quads: DataFrame, path: str, named: bool = False) -> None:
    """N-Triples, or N-Quads with graph names."""
    terms = [ntriples_column(F.col(c)) for c in "spo"]
    if named:
        terms.append(ntriples_column(F.col("g")))
    quads.select(F.concat(F.concat_ws(" ", *terms), F.lit(" .")).alias("value")).write.mode("overwrite").text(path)


def write_snapshot(quads: DataFrame, path: str) -> None:
    """The default graph, by predicate and in subject order: dictionary-encoded, compressed Parquet."""
    default = quads.where(F.col("g").isNull()).select("p", "s", "o")
    default.repartitionByRange("p", "s").sortWithinPartitions("p", "s", "o").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot's quads; its columns are checked."""
    df = spark.read.parquet(path)
    if sorted(df.columns) != ["o", "p", "s"] or {kind for _, kind in df.dtypes} != {"string"}:
        raise Malformed(f"not a snapshot: {df.schema.simpleString()}")
    return df.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")


#: Where negated mapping predicates live.
NEGATED = "urn:graphloom:not/"


def read_sssom(spark: SparkSession, path: str) -> DataFrame:
    """Mappings of an SSSOM table as ``g, s, p, o, confidence``.

    Names are expanded by the curie map in the header; a cell with ``|`` is
    several; modifier ``Not`` negates the predicate.
    """
    lines = spark.read.text(path)
    header = [r["value"] for r in lines.where(F.col("value").startswith("#")).collect()]
    curies = {}
    for line in header:
        name, found, space = line.lstrip("#").strip().partition(":")
        if found and space.strip().strip('"').startswith(("http", "urn")):
            curies[name.strip()] = space.strip().strip('"')
    df = spark.read.csv(path, sep="\t", header=True, comment="#")
    cells = {c: F.explode(F.split(F.col(c), r"\|")) for c in ("subject_id", "predicate_id", "object_id")}
    for c, expr in cells.items():
        df = df.withColumn(c, expr)

    def expanded(col: str) -> Column:
        name = F.trim(F.col(col))
        space = F.element_at(F.create_map(*[F.lit(x) for kv in curies.items() for x in kv]), F.substring_index(name, ":", 1)) if curies else F.lit(None)
        whole = F.when(name.rlike("^(https?|urn):"), name).otherwise(F.concat(space, F.regexp_replace(name, "^[^:]*:", "")))
        return F.concat(F.lit("<"), whole, F.lit(">"))

    predicate = expanded("predicate_id")
    if "predicate_modifier" in df.columns:
        local = F.regexp_extract(predicate, r"([^/#]+)>$", 1)
        predicate = F.when(F.lower("predicate_modifier") == "not", F.concat(F.lit(f"<{NEGATED}"), local, F.lit(">"))).otherwise(predicate)
    confidence = F.col("confidence").try_cast("double") if "confidence" in df.columns else F.lit(None).cast("double")
    out = df.select(F.lit(None).cast("string").alias("g"), expanded("subject_id").alias("s"), predicate.alias("p"), expanded("object_id").alias("o"), confidence.alias("confidence"))
    return out.where("s is not null and p is not null and o is not null").distinct()
