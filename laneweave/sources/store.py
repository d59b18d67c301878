"""The project store: users, projects and states as Parquet snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import PROJECTS, STATE, USERS

TABLES = {"users": USERS, "projects": PROJECTS, "state": STATE}


def write_store(store: dict[str, DataFrame], root: str) -> str:
    """Write all tables as one new snapshot, then publish it; returns its name.

    Readers see the snapshot that was published last, so a save is seen whole
    or not at all. A job that fails half-way leaves an unpublished folder.
    """
    spark = next(iter(store.values())).sparkSession
    name = uuid.uuid4().hex
    for table, df in store.items():
        df.write.parquet(f"{root}/snapshots/{name}/{table}")
    stamp = spark.range(1).select(F.lit(name).alias("snapshot"), F.current_timestamp().alias("at"))
    stamp.coalesce(1).write.mode("append").parquet(f"{root}/published")
    return name


commit_snapshot = write_store


def read_store(spark: SparkSession, root: str, tables: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of the snapshot published last."""
    last = spark.read.parquet(f"{root}/published").orderBy(F.desc("at")).first()
    return {t: spark.read.schema(schema).parquet(f"{root}/snapshots/{last.snapshot}/{t}") for t, schema in (tables or TABLES).items()}
