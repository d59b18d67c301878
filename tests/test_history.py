import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laneweave.operators import edits as log
from laneweave.operators.history import History
from laneweave.streaming.edits import autosave_stream, replay_stream

LOG = "project_id long, seq long, ts timestamp, action string, id string, object string"
ENTRY = st.tuples(st.sampled_from(["add", "add", "undo", "undo", "redo", "remove", "load", "odd"]), st.integers(1, 4), st.sampled_from("abc"), st.integers(0, 99), st.lists(st.tuples(st.sampled_from("abc"), st.integers(100, 199)), max_size=3))
ITEMS = st.lists(st.tuples(st.sampled_from("abc"), st.integers(200, 299)), max_size=5)


def model(entries, current=(), undone=()):
    c, u = list(current), list(undone)
    for action, n, i, obj, items in entries:
        for _ in range(n if action in ("undo", "redo") else 1):
            if action == "add":
                c, u = [*c, (i, obj)], []
            elif action == "remove":
                c, u = [e for e in c if e[0] != i], []
            elif action == "undo" and c:
                u.append(c.pop())
            elif action == "redo" and u:
                c.append(u.pop())
            elif action == "load":
                c, u = list(items), []
    return c, u


def reduced(entries, known=False):
    h = History(known)
    for action, n, i, obj, items in entries:
        h.apply(action, i, obj, n, items)
    return h


@settings(max_examples=400, deadline=None)
@given(st.lists(ENTRY, max_size=40), ITEMS, ITEMS, st.integers(0, 40), st.integers(0, 40))
def test_a_reduced_log_leads_every_state_where_the_log_does(entries, current, undone, i, j):
    want = model(entries, current, undone)
    short = [(*e, ()) for e in reduced(entries).entries()]
    assert model(short, current, undone) == want
    parts = [entries[: min(i, j)], entries[min(i, j) : max(i, j)], entries[max(i, j) :]]
    joined = [(*e, ()) for p in parts for e in reduced(p).entries()]
    again = [(*e, ()) for e in reduced(joined).entries()]
    assert model(joined, current, undone) == model(again, current, undone) == want
    h = History.after(current, undone)
    for action, n, k, obj, items in entries:
        h.apply(action, k, obj, n, items)
    assert h.state() == want


def test_moves_shrink_to_the_root_of_their_number():
    r = random.Random(2)
    h = History()
    for _ in range(20_000):
        h.apply(r.choice(["undo", "redo"]))
    assert len(list(h.entries())) < 100
    h = reduced([("add", 1, "x", k, ()) if k % 2 == 0 else ("undo", 1, "", 0, ()) for k in range(10_001)])
    assert len(list(h.entries())) == 1


def test_a_log_of_a_million_events_of_one_project(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(
        F.lit(7).cast("long").alias("project_id"), F.col("id").alias("seq"), F.expr("timestamp_micros(id * 1000)").alias("ts"),
        F.expr("case when id % 10 in (3, 4, 8) then 'undo' when id % 10 = 5 then 'redo' when id % 10 = 9 then 'remove' else 'add' end").alias("action"),
        F.expr("concat('e', case when id % 10 = 9 then id - 3 else id end)").alias("id"), F.lit("{}").alias("object"),
    )
    # Ten events: 0 1 2 are added, two are undone, one is redone, 6 and 7 are added, 7 is undone, 6 is removed.
    short = log.reduced(df.repartition(6))
    assert short.count() < n // 3 and short.select("at").distinct().count() > 1
    got = log.replay(df.repartition(6)).selectExpr("size(current) as n", "size(undone) as m", "current[0].id as a", "current[3].id as b", "element_at(current, -1).id as z").first()
    assert tuple(got) == (n // 5, 0, "e0", "e11", f"e{n - 9}")


def test_replay_edges(spark):
    load = json.dumps([{"id": "l", "object": "1"}, None, {"id": None}])
    rows = [(1, 1, None, "undo", None, None), (1, 2, None, "odd", None, None), (None, 1, None, "add", "n", "x"), (2, 1, None, "add", "a", None), (2, 2, None, "load", None, "no list"), (3, 1, None, "load", None, load), (3, 2, None, "undo", None, None), (4, 5, None, "add", None, "v"), (4, None, None, "add", "first", ""), (4, 6, None, "remove", None, None), (5, 1, None, "add", "t", "o"), (5, 1, None, "add", "t", "o")]
    df = spark.createDataFrame([(*r, 9) for r in rows], LOG + ", current int").repartition(3)
    got = {r.project_id: ([tuple(e) for e in r.current], [tuple(e) for e in r.undone]) for r in log.replay(df).collect()}
    assert got == {1: ([], []), None: ([("n", "x")], []), 2: ([], []), 3: ([("l", "1")], [(None, None)]), 4: ([("first", "")], []), 5: ([("t", "o")] * 2, [])}
    assert log.replay(df.limit(0)).count() == 0


def run(df, name, tmp_path, mode, **options):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def batches(spark, df, parts, path):
    for p in parts:
        df.where(F.col("seq").isin(p)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_of_shuffled_batches_is_the_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    rows, ids = [], []
    for s in range(60):
        action = r.choice(["add", "add", "add", "undo", "redo", "remove", "load" if s % 20 == 19 else "add"])
        ids.append(f"e{s}")
        rows.append((s % 4, s, action, r.choice(ids) if action == "remove" else f"e{s}", json.dumps([{"id": f"l{s}", "object": "o"}]) if action == "load" else f"o{s}"))
    df = spark.createDataFrame(rows, "project_id long, seq long, action string, id string, object string").withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + seq * interval 1 minute"))
    # Neighbouring stretches come in any order; some events an hour late, within the watermark.
    order = list(range(60))
    order.sort(key=lambda s: s + r.randint(-15, 15))
    stream = batches(spark, df, [order[i : i + 10] for i in range(0, 60, 10)], str(tmp_path / "in"))
    out = run(replay_stream(stream, "40 minutes"), f"replayed{seed}", tmp_path, "update")
    # Rows of a project in the order of batches: the last one has all its events.
    got = {x.project_id: x for x in out.collect()}
    want = {x.project_id: x for x in log.replay(df).collect()}
    assert {p: (x.current, x.undone) for p, x in got.items()} == {p: (x.current, x.undone) for p, x in want.items()}


def test_saves_on_a_stream_are_the_batch(spark, tmp_path):
    minutes = {1: "a", 2: "a", 3: "b", 12: "b", 22: "c", 23: "b", 40: "b", 50: "d", 51: "c", 70: "c", 90: None, 100: None, 110: "z"}
    rows = [(p, m, v) for p in (1, 2, None) for m, v in minutes.items()] + [(3, 500, "end")]
    df = spark.createDataFrame(rows, "project_id long, seq long, state string").withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + seq * interval 1 minute"))
    # 22 comes after 23 and 40, which the watermark still allows; 3 after 12.
    stream = batches(spark, df, [[1, 2], [12], [3], [23, 40], [22], [50, 51, 70], [90, 100, 110], [500]], str(tmp_path / "in"))
    out = run(autosave_stream(stream, watermark="30 minutes"), "saves", tmp_path, "append")
    want = log.autosave_points(df).where("project_id is null or project_id <> 3")
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert want.count() == 3 * 4
