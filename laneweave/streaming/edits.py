"""Edit log and automatic saves on streams, with the results that batch jobs have.

State lives in Spark's state store: keyed state with timers needs the RocksDB
provider, which both functions choose for the session's queries. Events older than
the watermark are dropped by Spark; all others count, in whatever order and
batch they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import signature
from ..operators.history import History

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ITEM = "struct<id:string,object:string>"


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in types.items()])


# Types as objects: workers have no session to read them from text.
_EDIT = _fields(id=T.StringType(), object=T.StringType())
_WAITING = _fields(seq=T.LongType(), at=T.LongType(), action=T.StringType(), id=T.StringType(), object=T.StringType(), loaded=T.ArrayType(_EDIT))

_SESSION = _fields(first=T.LongType(), last=T.LongType(), n=T.LongType(), state=T.StringType(), signature=T.StringType())


def with_state_store(spark: SparkSession) -> SparkSession:
    """Queries of the session that start from now on keep their state in RocksDB."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Replay(StatefulProcessor):
    """The state that is certain, and the events that an earlier one may still precede, which are replayed anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.current = handle.getListState("current", _EDIT)
        self.undone = handle.getListState("undone", _EDIT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ("seq", "at", "action", "id", "object", "loaded")
        came = [tuple(_plain(v) for v in r) for frame in rows for r in zip(*(frame[c].tolist() for c in columns))]
        waiting = self._settled([*(tuple(e) for e in self.waiting.get()), *came], timerValues.getCurrentWatermarkInMs())
        history = self._history()
        _apply(history, waiting)
        current, undone = history.state()
        item = lambda part: [{"id": i, "object": o} for i, o in part]
        ids = lambda part: ",".join(str(i) for i, _ in part)
        last = max((e[0] for e in [*waiting, *came] if e[0] is not None), default=None)
        yield pd.DataFrame({"project_id": [key[0]], "seq": [last], "current_ids": [ids(current)], "undone_ids": [ids(undone)], "current": [item(current)], "undone": [item(undone)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settled([tuple(e) for e in self.waiting.get()], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _history(self) -> History:
        return History.after([tuple(e) for e in self.current.get()], [tuple(e) for e in self.undone.get()])

    def _settled(self, waiting: list[tuple], watermark: int) -> list[tuple]:
        """Events that go on waiting; those that nothing can precede any more are counted for good."""
        waiting.sort(key=lambda e: tuple((v is not None, v) for v in (e[0], *e[2:5])))
        # An event waits for those before it, even where its own time has passed.
        ready = next((k for k, e in enumerate(waiting) if e[1] is not None and e[1] > watermark * 1000), len(waiting))
        if ready:
            history = self._history()
            _apply(history, waiting[:ready])
            for state, rows in zip((self.current, self.undone), history.state()):
                _put(state, rows)
        _put(self.waiting, waiting[ready:])
        if ready < len(waiting):
            self.handle.registerTimer(max(watermark, waiting[ready][1] // 1000) + 1)
        return waiting[ready:]

    def close(self) -> None:
        pass


def _apply(history: History, events: list[tuple]) -> None:
    for _, _, action, edit_id, obj, loaded in events:
        history.apply(action, edit_id, obj, items=[(x["id"], x["object"]) for x in _listed(loaded)])


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put([tuple(r) for r in rows])
    else:
        state.clear()


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


def _listed(v) -> list:
    return [] if v is None else [x for x in v if x is not None]


def replay_stream(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(project_id, seq, current_ids, undone_ids, current, undone) of each project with new events, after every micro-batch.

    Always what ``operators.edits.replay`` gives for the events so far, in
    whatever order and batch they come: those that an earlier one may still
    precede are kept and replayed by seq; once the watermark has passed an
    event's ``ts`` and those of all before it in seq, it is counted for good.
    ``seq`` is the greatest one so far. Events later than the watermark are
    dropped, as Spark does; a null ``ts`` keeps nothing waiting. Update mode.
    """
    with_state_store(log.sparkSession)
    items = F.when(F.col("action") == "load", F.from_json("object", f"array<{_ITEM}>"))
    rows = log.withWatermark("ts", watermark).select(
        "project_id", "ts", F.col("seq").cast("long").alias("seq"), F.unix_micros("ts").alias("at"), "action", F.col("id").cast("string").alias("id"), F.col("object").cast("string").alias("object"), items.alias("loaded")
    )
    key = log.schema["project_id"].dataType.simpleString()
    out = f"project_id {key}, seq long, current_ids string, undone_ids string, current array<{_ITEM}>, undone array<{_ITEM}>"
    return rows.groupBy("project_id").transformWithStateInPandas(_Replay(), out, "Update", "EventTime")


class _Saves(StatefulProcessor):
    """Open sessions of changes, and the signature of the last save; a timer closes a session."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _SESSION)
        self.last = handle.getValueState("signature", _fields(signature=T.StringType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [(at, at, 1, _plain(state), sign) for f in rows for at, state, sign in zip(f["at"].tolist(), f["state"].tolist(), f["signature"].tolist())]
        yield from self._closed(key, [*(tuple(s) for s in self.open.get()), *came], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._closed(key, [tuple(s) for s in self.open.get()], timerValues.getCurrentWatermarkInMs())

    def _closed(self, key, sessions: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        merged: list[tuple] = []
        for s in sorted(sessions, key=lambda s: s[:2]):
            if merged and s[0] <= merged[-1][1] + self.gap:
                b = merged[-1]
                later = max(b, s, key=lambda x: (x[1], x[3] is not None, (x[3] or "").encode()))
                merged[-1] = (b[0], later[1], b[2] + s[2], later[3], later[4])
            else:
                merged.append(s)
        ends = [s[1] + self.gap for s in merged]
        n = sum(e <= watermark * 1000 for e in ends)
        _put(self.open, merged[n:])
        if n < len(merged):
            self.handle.registerTimer(max(watermark, ends[n] // 1000) + 1)
        before = self.last.get()[0] if n and self.last.exists() else None
        saves = []
        for s, end in zip(merged[:n], ends):
            if s[4] != before:
                saves.append((key[0], end, s[0], s[1], s[2], s[4]))
            before = s[4]
        if n:
            self.last.update((before,))
        if saves:
            yield pd.DataFrame(saves, columns=["project_id", "saved_at", "first_change", "last_change", "changes", "signature"])

    def close(self) -> None:
        pass


def autosave_stream(changes: DataFrame, gap: str = "120 seconds", watermark: str = "5 minutes") -> DataFrame:
    """(project_id, saved_at, first_change, last_change, changes, signature): a save when a session of changes has closed.

    As ``operators.edits.autosave_points``: a save comes ``gap`` after the last
    change, once the watermark has passed that time, and is left out if its
    content equals that of the project's save before it, in whatever batch that
    was. Changes may come in any order and batch; those later than the
    watermark are dropped, and those without a time. ``state`` is compared as
    text where two changes have the same time. Append mode.
    """
    spark = with_state_store(changes.sparkSession)
    micros = int(spark.sql(f"select cast(interval {gap} as interval day to second) as g").first().g.total_seconds() * 1_000_000)
    rows = changes.withWatermark("ts", watermark).where("ts is not null").select("project_id", "ts", F.unix_micros("ts").alias("at"), F.col("state").cast("string").alias("state"), signature(F.col("state")).alias("signature"))
    key = changes.schema["project_id"].dataType.simpleString()
    out = f"project_id {key}, saved_at long, first_change long, last_change long, changes long, signature string"
    saves = rows.groupBy("project_id").transformWithStateInPandas(_Saves(micros), out, "Append", "EventTime")
    return saves.withColumns({c: F.timestamp_micros(c) for c in ("saved_at", "first_change", "last_change")})
