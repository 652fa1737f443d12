"""Digests of settings, paths for reports, timing and the progress table."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.settings import Settings

LOG = logging.getLogger("panelmill")
STATUSES = ("pending", "running", "complete")


class LoadError(ValueError):
    """Input that can't be loaded as what it should be."""


def settings_digest(settings: Settings) -> str:
    """16 hex digits that name a set of settings."""
    return hashlib.sha256(json.dumps(asdict(settings), sort_keys=True).encode()).hexdigest()[:16]


def shown_path(path: str | Path, root: str | Path) -> str:
    """The path below root; of a path elsewhere its name only, so that no absolute path is shown."""
    path, root = Path(path).resolve(), Path(root).resolve()
    return path.relative_to(root).as_posix() if path.is_relative_to(root) else path.name


@contextmanager
def timed(what: str, log: logging.Logger = LOG) -> Iterator[None]:
    start = time.perf_counter()
    try:
        yield
    finally:
        log.info("%s took %.2f s", what, time.perf_counter() - start)


def key_column(*names: str) -> Column:
    """`seeds.cell_key` of named columns, in Spark: strings are quoted, numbers aren't."""
    def value(name: str) -> Column:
        return F.to_json(F.struct(F.col(name).alias("v")))

    parts = [F.concat(F.lit(f'"{n}": '), F.regexp_extract(value(n), r'^\{"v":(.*)\}$', 1)) for n in sorted(names)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16)


def seed_column(base: int, label: Column) -> Column:
    """`seeds.derive_seed` of a column of labels, in Spark."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{base}:"), label), 256), 1, 8), 16, 10).cast("long")


def mark(spark: SparkSession, path: str, phase: int, status: str, note: str = "") -> None:
    """Append a phase's status to the progress table."""
    if status not in STATUSES:
        raise ValueError(f"no status {status}")
    rows = spark.createDataFrame([(phase, status, note)], "phase int, status string, note string")
    rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each phase."""
    from panelmill.sources.files import keep_last

    return keep_last(spark.read.parquet(path), ["phase"], ["at"])
