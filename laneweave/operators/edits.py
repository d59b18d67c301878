"""The edit log: replay with undo and redo, automatic saves, change detection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import signature
from .history import History

_ITEM = "struct<id:string,object:string>"


_TOKENS = "project_id {key}, at long, pos long, action string, n long, id string, object string"


def _events(log: DataFrame) -> DataFrame:
    items = F.when(F.col("action") == "load", F.from_json("object", f"array<{_ITEM}>"))
    return log.select("project_id", F.col("seq").cast("long").alias("seq"), "action", F.col("id").cast("string").alias("id"), F.col("object").cast("string").alias("object"), items.alias("items"))


def _histories(batches, columns: list[str], known: bool):
    """(project, first place, history) of each run of rows of one project, in order."""
    project, at, history = None, None, None
    for batch in batches:
        for key, place, *event in zip(*(batch.column(c).to_pylist() for c in columns)):
            if history is None or key != project:
                if history is not None:
                    yield project, at, history
                project, at, history = key, place, History(known)
            history.apply(*event)
    if history is not None:
        yield project, at, history


def reduced(log: DataFrame) -> DataFrame:
    """A shorter log (project_id, at, pos, action, n, id, object) that leads every state to where ``log`` leads it.

    Stretches of the log, wherever projects begin and end, are reduced by as
    many tasks as it needs; ``at`` and ``pos`` give the order, ``n`` says how
    often an undo or redo is meant. See ``history``.
    """
    key = log.schema["project_id"].dataType
    order = ["project_id", "seq", "action", "id", "object"]

    def run(batches):
        names = ["project_id", "seq", "action", "id", "object", "n", "items"]
        plain = (b.set_column(b.schema.get_field_index("items"), "items", _pairs(b.column("items"))).append_column("n", pa.array([1] * b.num_rows, pa.int64())) for b in batches)
        out: list[tuple] = []
        for project, at, history in _histories(plain, names, False):
            entries = list(history.entries()) or [("none", 1, None, None)]
            out += [(project, at, pos, *e) for pos, e in enumerate(entries)]
            if len(out) > 20_000:
                yield _token_batch(out, kind)
                out = []
        yield _token_batch(out, kind)

    kind = to_arrow_type(key)
    dealt = _events(log).repartitionByRange("project_id", "seq").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _TOKENS.format(key=key.simpleString()))


def _pairs(items: pa.Array) -> pa.Array:
    """Lists without the entries that are null, null lists as empty ones, as the reduction takes them."""
    return pa.array([[(x["id"], x["object"]) for x in r or () if x is not None] for r in items.to_pylist()], pa.list_(pa.list_(pa.string())))


def _token_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["project_id", "at", "pos", "action", "n", "id", "object"])


def replay(log: DataFrame) -> DataFrame:
    """(project_id, current, undone): the edits that stand after the log, and those that redo brings back.

    add appends and forgets what was undone; remove drops all with the id and
    forgets; undo moves the last to the undone, redo moves it back, either
    does nothing where there is none; load replaces all and forgets. Undo does
    not bring back what was removed. For load, ``object`` is a JSON array of
    {id, object}; anything else loads nothing. Other actions do nothing.

    The log is reduced in stretches first, by the order of (project_id, seq)
    and not by project, so that one project's log of any length is work for
    many tasks; what is left of each project is then folded, in time that
    grows with its length. Events of equal seq go by action, id and object. A
    null project is a project of its own, a null seq comes first. An empty log
    gives an empty result. Columns other than project_id, seq, action, id and
    object do not matter.
    """
    key = log.schema["project_id"].dataType
    kind = to_arrow_type(key)
    item = pa.struct([("id", pa.string()), ("object", pa.string())])

    def run(batches):
        for project, _, history in _histories(batches, ["project_id", "at", "action", "id", "object", "n"], True):
            lists = [pa.array([[{"id": i, "object": o} for i, o in part]], pa.list_(item)) for part in history.state()]
            yield pa.RecordBatch.from_arrays([pa.array([project], kind), *lists], names=["project_id", "current", "undone"])

    short = reduced(log).repartition("project_id").sortWithinPartitions("project_id", "at", "pos")
    return short.mapInArrow(run, f"project_id {key.simpleString()}, current array<{_ITEM}>, undone array<{_ITEM}>")


def last_edit(replayed: DataFrame) -> DataFrame:
    """What undo would take next, null where there is nothing."""
    return replayed.select("project_id", F.try_element_at("current", F.lit(-1)).alias("last"))


def autosave_points(changes: DataFrame, gap: str = "120 seconds") -> DataFrame:
    """(project_id, saved_at, first_change, last_change, changes, signature): one save ``gap`` after each last change.

    A save whose content equals the one before it is left out. ``changes`` has
    project_id, ts and state; of changes at the same time the one with the
    greatest state counts as the last.
    """
    quiet = changes.groupBy("project_id", F.session_window("ts", gap).alias("w")).agg(F.max_by("state", F.struct("ts", "state")).alias("state"), F.max("ts").alias("last_change"), F.count(F.lit(1)).alias("changes"))
    saves = quiet.select("project_id", F.col("w.end").alias("saved_at"), F.col("w.start").alias("first_change"), "last_change", "changes", signature(F.col("state")).alias("signature"))
    return changed_since_last(saves, "project_id", "signature", "saved_at").where("changed").drop("changed")


def changed_since_last(df: DataFrame, key: str, sign: str, order: str) -> DataFrame:
    """``changed`` is false where the signature equals that of the row before."""
    before = F.lag(sign).over(W.partitionBy(key).orderBy(order))
    return df.withColumn("changed", ~F.col(sign).eqNullSafe(before))


def affected_projects(before: DataFrame, after: DataFrame) -> DataFrame:
    """Projects whose graph has another number of nodes or edges than before: their routes are out of date.

    Both tables have project_id, nodes and edges, as ``graph.network_report``
    gives them. A project in one of them alone is affected; a null counts as
    a number of its own.
    """
    old = before.select("project_id", F.struct("nodes", "edges").alias("__old"))
    new = after.select("project_id", F.struct("nodes", "edges").alias("__new"))
    return old.join(new, "project_id", "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new"))).select("project_id")
