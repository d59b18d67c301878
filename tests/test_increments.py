"""Sizes kept by changes against full reports."""

import glob
import random

from pyspark.sql import functions as F

from laneweave.operators import graph, increments
from laneweave.sources.scratch import fresh_path

CHANGES = "project_id long, feature_seq long, feature_class string, feature_id long, kind string, tags map<string,string>, geometry array<struct<lat:double,lng:double>>, action string"


def _road(rng, project, i):
    y, x = rng.randrange(5), rng.randrange(5)
    steps = [(y, x)]
    for _ in range(rng.randint(1, 4)):
        y, x = max(0, min(4, y + rng.choice((-1, 0, 1)))), max(0, min(4, x + rng.choice((-1, 1))))
        steps.append((y, x))
    return (project, i, "road", i, "residential", {}, [{"lat": 48 + a * 0.001, "lng": 9 + b * 0.001} for a, b in steps])


def _report(spark, rows):
    full = graph.network_report(spark.createDataFrame([(*r, "add") for r in rows], CHANGES))
    return {r.project_id: (r.nodes, r.edges, r.dead_ends) for r in full.collect()}


def test_sizes_after_adds_and_removals_are_those_of_a_full_report(spark):
    rng = random.Random(3)
    root = fresh_path(spark, "sizes")
    increments.create(spark, root)
    there, before, number = [], {}, 0
    for batch in range(3):
        gone = rng.sample([r for r in there if r[0] != 4], min(len(there) // 3, 6))
        new = [_road(rng, rng.choice((1, 2, 3) if batch else (1, 2, 3, 4)), number + k) for k in range(10)]
        number += 10
        same = [r for r in there if r not in gone][:1]  # a copy of a road that stays adds no edge
        changes = [(*r, "add") for r in new + same] + [(*r, "remove") for r in gone] + [(7, 1, "road", 1, "x", {}, None, "add"), (8, 1, "building", 1, "x", {}, [], "add"), (None, *new[0][1:], "add")]
        changes += [(*new[0], None), (*new[0], "keep")]
        for r in gone:
            there.remove(r)
        there += new + same
        df = spark.createDataFrame(changes, CHANGES).withColumn("n", F.lit("clash")).withColumn("bucket", F.lit(1))
        for _ in range(2 if batch == 1 else 1):  # a batch that is run again changes nothing
            got = {r.project_id: r for r in increments.apply_changes(df, root, batch).collect()}
        want = _report(spark, there)
        assert set(got) == {c[0] for c in changes} - {None}
        for p, r in got.items():
            assert (r.nodes, r.edges, r.dead_ends) == want.get(p, (0, 0, 0)), (batch, p)
            assert (r.nodes_before, r.edges_before) == before.get(p, (0, 0, 0))[:2]
            assert r.affected == ((r.nodes, r.edges) != (r.nodes_before, r.edges_before))
        assert not got[7].affected and not got[8].affected
        before = want
        assert {r.project_id: (r.nodes, r.edges, r.dead_ends) for r in increments.sizes(spark, root).collect()} == want
    small = fresh_path(spark, "sizes")
    increments.compact(spark, root, small)
    assert {r.project_id: (r.nodes, r.edges, r.dead_ends) for r in increments.sizes(spark, small).collect()} == before
    # Parallel roads: one of two goes, nothing changes; all go, and the project is empty. Nothing of other folders is read.
    mine = spark.createDataFrame([(*r, "remove") for r in there if r[0] == 1], CHANGES)
    bucket = mine.select(increments._bucket()).first()[0]
    others = [f for f in glob.glob(small.removeprefix("file://") + "/*/batch=-1/bucket=*/*.parquet") if f"bucket={bucket}/" not in f and "bucket=-1/" not in f]
    assert len(others) > 2
    for f in others:
        with open(f, "wb") as out:
            out.write(b"not read")
    r = increments.apply_changes(mine, small, 0).first()
    assert (r.nodes, r.edges, r.dead_ends, r.affected) == (0, 0, 0, True)
    assert increments.apply_changes(mine.where("false"), small, 1).count() == 0


def test_a_stream_of_changes(spark, tmp_path):
    root = fresh_path(spark, "sizes")
    increments.create(spark, root)
    rng = random.Random(8)
    rows = [_road(rng, 1, i) for i in range(6)]
    schema = spark.createDataFrame([], CHANGES).schema
    for k, part in enumerate(([(*r, "add") for r in rows], [(*rows[0], "add")], [(*r, "remove") for r in rows[3:]])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        increments.affected_stream(stream, root).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination(120)
    out = {r.batch: r for r in spark.read.parquet(f"{root}/affected").collect()}
    first, last = _report(spark, rows)[1], _report(spark, rows[:3])[1]
    assert (out[0].nodes, out[0].edges, out[0].affected) == (*first[:2], True)
    assert not out[1].affected and (out[2].nodes, out[2].edges, out[2].dead_ends) == last
