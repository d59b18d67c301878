import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from laneweave.operators import projects, saves, validate
from laneweave.sources import schemas, versions

BOX = (1.0, 0.0, 1.0, 0.0)
ROW = "id string, v int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROW)


def keys(spark, *k):
    return spark.createDataFrame([(x,) for x in k], "id string")


def content(spark, root, version=None):
    return sorted((tuple(r) for r in versions.read(spark, root, "t", version).collect()), key=str)


def folders(root, table="t"):
    return {(p.split(os.sep)[-2], p.split("=")[-1]) for p in glob.glob(f"{root}/data/{table}/*/bucket=*")}


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "store")
    versions.create(spark, path, {"t": (ROW, "id"), "other": (ROW, "id")}, 8)
    return path


def test_rows_of_all_commits(spark, root):
    assert content(spark, root) == [] and versions.latest(spark, root) == 0
    versions.commit(spark, root, 0, {"t": rows(spark, ("a", 1), ("b", 2), (None, 3))})
    versions.commit(spark, root, 1, {"t": rows(spark, ("a", 5), ("a", 4), ("c", 1))}, {"t": keys(spark, "b", "c", "nobody")})
    now = [("a", 5), ("c", 1), (None, 3)]
    assert content(spark, root) == now
    assert content(spark, root, 1) == [("a", 1), ("b", 2), (None, 3)] and content(spark, root, 0) == []
    assert versions.compact(spark, root, 4) == 2  # nothing to do
    assert versions.compact(spark, root, 1) == 3 and content(spark, root) == now
    versions.commit(spark, root, 3, {"t": rows(spark)}, {"t": keys(spark)})
    versions.commit(spark, root, 4, dropped={"t": keys(spark, None)})
    assert content(spark, root) == now[:2] and content(spark, root, 4) == now
    versions.forget(spark, root, 1)
    assert content(spark, root) == now[:2] and versions.latest(spark, root) == 5
    assert sorted(os.listdir(f"{root}/versions")) == [f"{5:020d}"]
    named = {f for f, _ in versions._manifest(spark, root, 5)["tables"]["t"]["folders"]}
    assert {f for f, _ in folders(root)} == named


def test_a_commit_writes_and_reads_its_buckets_only(spark, root):
    versions.commit(spark, root, 0, {"t": spark.range(200).selectExpr("cast(id as string) as id", "cast(id as int) as v")})
    before = folders(root)
    assert len(before) == 8
    versions.commit(spark, root, 1, {"t": rows(spark, ("7", -7))})
    added = folders(root) - before
    assert len(added) == 1 and not glob.glob(f"{root}/data/other/*")
    near = versions.read(spark, root, "t", keys=keys(spark, "7"))
    assert near.count() < 60 and {r.v for r in near.where("id = '7'").collect()} == {-7}
    assert {f.split("bucket=")[1].split("/")[0] for f in near.inputFiles()} == {next(iter(added))[1]}
    assert versions.read(spark, root, "t", keys=keys(spark)).count() == 0 and versions.read(spark, root, "t").count() == 200


def test_of_two_writers_one_is_refused(spark, root):
    versions.commit(spark, root, 0, {"t": rows(spark, ("a", 0))})

    def write(i):
        try:
            return versions.commit(spark, root, 1, {"t": rows(spark, ("a", i))})
        except versions.Refused:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, range(1, 5)))
    won = [i for i, g in zip(range(1, 5), got, strict=True) if g == 2]
    assert len(won) == 1 and got.count(None) == 3 and content(spark, root) == [("a", won[0])]
    assert len(folders(root)) == 2 and os.listdir(f"{root}/drafts") == []  # nothing is left of the others
    with pytest.raises(versions.Refused):
        versions.create(spark, root, {"t": (ROW, "id")})


def test_late_publication_is_refused_and_cleaned(spark, root, monkeypatch):
    """The other writer comes between the look at the last version and the publication."""
    versions.commit(spark, root, 0, {"t": rows(spark, ("a", 0))})
    before = folders(root)
    monkeypatch.setattr(versions, "latest", lambda *_: 0)
    with pytest.raises(versions.Refused):
        versions.commit(spark, root, 0, {"t": rows(spark, ("a", 9))})
    assert folders(root) == before and content(spark, root, 1) == [("a", 0)]


def test_rename_refuses_a_name_that_is_taken(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    at = lambda n: versions._file_system(spark, f"file://{tmp_path}/{n}")[1]
    assert versions._rename_new(spark, at("a"), at("c")) and not versions._rename_new(spark, at("b"), at("c"))
    assert (tmp_path / "c").read_text() == "a"


def test_what_cannot_be_stored(spark, tmp_path, root):
    for schema in ("id string, m map<string,string>", "id string, version int"):
        with pytest.raises(ValueError):
            versions.create(spark, str(tmp_path / "x"), {"t": (schema, "id")})
    with pytest.raises(KeyError):
        versions.commit(spark, root, 0, {"nothing": rows(spark)})


def test_saves_and_removals(spark, tmp_path):
    root, now = str(tmp_path / "projects"), F.lit("2024-01-02 00:00:00")
    saves.create(spark, root, 16)
    make = lambda *r: spark.createDataFrame(list(r), schemas.SAVE_REQUESTS)
    first = make((1, "u1", "", "one", BOX, "{}", "[1]"), (2, "u2", None, "two", BOX, "{}", "[2]"), (3, "u3", "p9", "never", BOX, "{}", "[3]"), (4, None, "", "nobody", (None, 0.0, 1.0, 0.0), "{}", "[4]"))
    version, rejected = saves.save_batch(spark, root, first, now)
    assert version == 1 and {r.seq: r.reject_reason for r in rejected.collect()} == {3: "NOT_FOUND", 4: "BAD_BBOX"}
    read = lambda t, v=None: versions.read(spark, root, t, v)
    ids = {r.name: r.id for r in read("projects").collect()}
    assert set(ids) == {"one", "two"} and {r.id for r in read("users").collect()} == {"u1", "u2", "u3"}
    assert saves.save_batch(spark, root, first, now)[0] == 2 and {r.name: r.id for r in read("projects").collect()} == ids  # again changes nothing
    second = make((5, "u1", ids["one"], "uno", BOX, "{}", "[5]"), (6, "u1", ids["one"], "eins", BOX, "{}", "[6]"), (7, "u1", ids["two"], "theirs", BOX, "{}", "[7]"))
    _, rejected = saves.save_batch(spark, root, second, F.lit("2024-01-03 00:00:00"))
    assert [r.seq for r in rejected.collect()] == [7]
    got = projects.get_project(read("projects"), read("state"), ids["one"], "u1").first()
    assert (got.name, got.user_edits, got.created_at.day, got.updated_at.day) == ("eins", "[6]", 2, 3)
    saves.remove_users(spark, root, spark.createDataFrame([("u1",), (None,)], "user_id string"))
    assert [r.name for r in read("projects").collect()] == ["two"] and [r.project_id for r in read("state").collect()] == [ids["two"]] and {r.id for r in read("users").collect()} == {"u2", "u3"}
    assert read("projects", 3).count() == 2
    versions.compact(spark, root, 1)
    assert [read(t).count() for t in saves.TABLES] == [2, 1, 1]
    assert saves.save_batch(spark, root, make(), now)[1].count() == 0


def test_requests_are_judged_once(spark, tmp_path, monkeypatch):
    root, looked, judge = str(tmp_path / "projects"), spark.sparkContext.accumulator(0), validate.save_reject_reason

    def look(reason):
        looked.add(1)
        return reason

    counted = lambda df: judge(df).withColumn("reject_reason", F.udf(look)("reject_reason"))
    monkeypatch.setattr(saves, "save_reject_reason", counted)
    monkeypatch.setattr(projects, "save_reject_reason", counted)
    saves.create(spark, root, 4)
    requests = [(n, f"u{n % 3}", "" if n % 4 else "p9", f"plan {n}", BOX, "{}", f"[{n}]") for n in range(20)]
    _, rejected = saves.save_batch(spark, root, spark.createDataFrame(requests, schemas.SAVE_REQUESTS), F.lit("2024-01-02 00:00:00"))
    assert {(r.seq, r.reject_reason) for r in rejected.collect()} == {(n, "NOT_FOUND") for n in range(0, 20, 4)}
    assert versions.read(spark, root, "projects").count() == 15 and looked.value == 20
