"""Keyed tables as versions of small changes.

A commit writes the rows that it saves or drops, in folders of the buckets
that their keys hash to, and then publishes the next version: one small file
that names all live folders of all tables. So a commit writes no more than its
own rows, is seen whole or not at all, and of two writers who start from one
version the later is refused. Readers take a version and go on reading it
while others write. ``compact`` merges buckets that many commits have touched.

A bucket that one folder holds is read as it is; of a key that lies in several
folders the latest row counts. Publishing goes through the Hadoop file system
of the session and needs one whose rename refuses a name that is taken (HDFS;
on local disks a hard link does it); object stores without one are not served.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, MapType, StructType

BUCKETS = 256

#: Columns of a stored row beside the table's own.
_STORED = ("deleted", "version")


class Refused(RuntimeError):
    """Another writer has published the version that this one was to make."""


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def _link_new(draft: str, target: str) -> bool:
    try:
        os.link(draft, target)
    except FileExistsError:
        return False
    return True


def _rename_new(spark: SparkSession, draft, target) -> bool:
    fs = spark._jvm.org.apache.hadoop.fs
    kinds = getattr(fs, "Options$Rename")
    never = spark.sparkContext._gateway.new_array(kinds, 0)
    try:
        fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, never)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _publish(spark: SparkSession, root: str, number: int, manifest: dict) -> None:
    """Make a version whole and at once, or not at all."""
    fs, draft = _file_system(spark, f"{root}/drafts/{uuid.uuid4().hex}")
    _, target = _file_system(spark, f"{root}/versions/{number:020d}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        done = _link_new(draft.toUri().getPath(), target.toUri().getPath())
    else:
        done = _rename_new(spark, draft, target)
    fs.delete(draft, False)
    if not done:
        raise Refused(f"version {number} of {root} is there already")


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{version:020d}", wholetext=True).first()[0])


def create(spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS) -> int:
    """Version 0: empty ``tables``, a schema and a key column for each. Refused where there is a store.

    Columns that have no order (maps) and columns ``deleted`` and ``version`` are a ValueError.
    """
    held = {}
    for name, (schema, key) in tables.items():
        fields = spark.createDataFrame([], schema).schema
        if set(_STORED) & {f.name.lower() for f in fields} or any(isinstance(f.dataType, MapType) for f in fields):
            raise ValueError(f"{name}: maps and columns {_STORED} cannot be stored")
        fields[key]  # KeyError where it is not there
        held[name] = {"schema": fields.jsonValue(), "key": key, "folders": []}
    _publish(spark, root, 0, {"buckets": buckets, "tables": held})
    return 0


def latest(spark: SparkSession, root: str) -> int:
    """Number of the last version."""
    return max(int(n) for n in _names(spark, f"{root}/versions") if n.isdigit())


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _stored_schema(table: dict) -> StructType:
    return StructType.fromJson(table["schema"]).add("deleted", BooleanType()).add("version", LongType())


def _folders(table: dict) -> dict[int, list[str]]:
    """Live folders of each bucket."""
    found: dict[int, list[str]] = {}
    for folder, buckets in table["folders"]:
        for b in buckets:
            found.setdefault(b, []).append(folder)
    return found


def _rows(spark: SparkSession, root: str, name: str, table: dict, held: dict[int, list[str]]) -> DataFrame:
    """The latest row of every key of some buckets, dropped ones included."""
    schema = _stored_schema(table)

    def load(several: bool) -> DataFrame:
        paths = [f"{root}/data/{name}/{f}/bucket={b}" for b, folders in sorted(held.items()) if (len(folders) > 1) == several for f in folders]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    merged = load(True).groupBy(table["key"]).agg(F.max_by(F.struct(*schema.names), "version").alias("r")).select("r.*")
    return load(False).unionByName(merged)


def read(spark: SparkSession, root: str, name: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """A table at a version, the last one if null.

    With ``keys``, whose first column is compared with the table's key, only
    buckets to which one of them hashes are read, with all that lies in them:
    join for the rows. What comes to the driver are numbers of buckets.
    """
    manifest = _manifest(spark, root, latest(spark, root) if version is None else version)
    table = manifest["tables"][name]
    held = _folders(table)
    if keys is not None:
        wanted = {r[0] for r in keys.select(_bucket(F.col(f"`{keys.columns[0]}`"), manifest["buckets"])).distinct().collect()}
        held = {b: f for b, f in held.items() if b in wanted}
    return _rows(spark, root, name, table, held).where("not deleted").drop(*_STORED)


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> list[int]:
    """One row of each key, a folder a bucket; returns the buckets. One shuffle: the merge is by bucket as well."""
    dealt = rows.withColumn("bucket", _bucket(F.col(key), buckets)).repartition("bucket")
    # Of a key that is dropped and saved the saved row counts, of repeated rows the greatest.
    one = F.max(F.struct((~F.col("deleted")).alias("__saved"), F.struct(*rows.columns).alias("r"))).alias("o")
    dealt.groupBy("bucket", key).agg(one).select("bucket", "o.r.*").write.partitionBy("bucket").parquet(path)
    return sorted(int(n.removeprefix("bucket=")) for n in _names(rows.sparkSession, path) if n.startswith("bucket="))


def commit(spark: SparkSession, root: str, base: int, saved: dict[str, DataFrame] | None = None, dropped: dict[str, DataFrame] | None = None) -> int:
    """The version after ``base``: rows of ``saved`` in place of those of their keys, keys of ``dropped`` gone.

    All tables change together. Refused if ``base`` is no longer the last
    version; then nothing is left of the attempt. ``dropped`` has a table's
    keys in its first column; a key in both is saved; of rows repeated for a
    key the greatest counts; a null key is a key. Rows that equal what is there
    are written all the same: leave them out before. A job that is lost
    half-way leaves a folder that no version names.
    """
    if latest(spark, root) != base:
        raise Refused(f"version {base} of {root} is not the last")
    manifest = _manifest(spark, root, base)
    saved, dropped = saved or {}, dropped or {}
    folder = f"{base + 1:020d}-{uuid.uuid4().hex}"
    touched = [n for n in manifest["tables"] if n in saved or n in dropped]
    if unknown := (set(saved) | set(dropped)) - set(touched):
        raise KeyError(f"no tables {sorted(unknown)}")
    try:
        for name in touched:
            table = manifest["tables"][name]
            schema = _stored_schema(table)
            rows = spark.createDataFrame([], schema)
            number = F.lit(base + 1).cast("long").alias("version")
            own = schema.names[: -len(_STORED)]
            if name in saved:
                rows = rows.unionByName(saved[name].select(*[F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in own], F.lit(False).alias("deleted"), number))
            if name in dropped:
                gone = F.col(f"`{dropped[name].columns[0]}`")
                rows = rows.unionByName(dropped[name].select(*[(gone if c == table["key"] else F.lit(None)).cast(schema[c].dataType).alias(c) for c in own], F.lit(True).alias("deleted"), number))
            buckets = _write(rows, f"{root}/data/{name}/{folder}", table["key"], manifest["buckets"])
            if buckets:
                table["folders"].append([folder, buckets])
        _publish(spark, root, base + 1, manifest)
    except Refused:
        for name in touched:
            _remove(spark, f"{root}/data/{name}/{folder}")
        raise
    return base + 1


def compact(spark: SparkSession, root: str, most: int = 4) -> int:
    """A version with the same rows in which buckets of more than ``most`` folders are one folder; the last one if there are none.

    Keys that were dropped are forgotten in these buckets. Refused if another
    writer came first: nothing is lost, try again.
    """
    base = latest(spark, root)
    manifest = _manifest(spark, root, base)
    folder = f"{base + 1:020d}-{uuid.uuid4().hex}"
    changed = []
    for name, table in manifest["tables"].items():
        full = {b: f for b, f in _folders(table).items() if len(f) > most}
        if full:
            changed.append(name)
            rows = _rows(spark, root, name, table, full).where("not deleted")
            buckets = _write(rows, f"{root}/data/{name}/{folder}", table["key"], manifest["buckets"])
            kept = [[f, [b for b in held if b not in full]] for f, held in table["folders"]]
            table["folders"] = [[f, held] for f, held in [*kept, [folder, buckets]] if held]
    if not changed:
        return base
    try:
        _publish(spark, root, base + 1, manifest)
    except Refused:
        for name in changed:
            _remove(spark, f"{root}/data/{name}/{folder}")
        raise
    return base + 1


def forget(spark: SparkSession, root: str, keep: int = 10) -> None:
    """Drop all but the last ``keep`` versions, and the folders that they alone name."""
    numbers = sorted(int(n) for n in _names(spark, f"{root}/versions") if n.isdigit())
    old, kept = numbers[:-keep], numbers[-keep:]
    named = lambda vs: {(t, f) for v in vs for t, table in _manifest(spark, root, v)["tables"].items() for f, _ in table["folders"]}
    gone = named(old) - named(kept)
    for v in old:
        _remove(spark, f"{root}/versions/{v:020d}")
    for name, folder in sorted(gone):
        _remove(spark, f"{root}/data/{name}/{folder}")
