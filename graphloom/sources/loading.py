"""Bulk loading with counts of what was read."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import checkpointed
from .files import found_files, read_each


@dataclass(frozen=True)
class LoadStats:
    """Files and statements read, quads kept, those that were there already in this load, and graphs with a quad."""

    files: int
    read: int
    quads: int
    repeated: int
    graphs: int
    seconds: float

    @property
    def per_second(self) -> float:
        return self.read / self.seconds if self.seconds else 0.0


def load(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, LoadStats]:
    """The set of quads of files and folders, written once, and what the load found.

    Files are parsed once: equal quads are added up in the same shuffle that makes them a set.
    """
    began = time.monotonic()
    names = found_files(spark, paths)
    counted = checkpointed(read_each(spark, names).groupBy("g", "s", "p", "o").agg(F.count(F.lit(1)).alias("~times")))
    row = counted.agg(F.coalesce(F.sum("~times"), F.lit(0)), F.count(F.lit(1)), F.count_distinct(F.coalesce("g", F.lit("")))).first()
    files = sum(map(len, names.values()))
    return counted.drop("~times"), LoadStats(files, row[0], row[1], row[0] - row[1], row[2], time.monotonic() - began)
