"""Saves and removals of projects as commits to a store of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import new_id
from ..sources import versions
from ..sources.schemas import PROJECTS, STATE, USERS
from ..sources.scratch import written
from .projects import applied, ensure_users, judged, last_accepted
from .validate import save_reject_reason

TABLES = {"users": (USERS, "id"), "projects": (PROJECTS, "id"), "state": (STATE, "project_id")}


def create(spark: SparkSession, root: str, buckets: int = versions.BUCKETS) -> int:
    """An empty store of users, projects and state."""
    return versions.create(spark, root, TABLES, buckets)


def save_batch(spark: SparkSession, root: str, requests: DataFrame, now: Column) -> tuple[int, DataFrame]:
    """(version, rejected) after a batch of save requests, as ``save_projects``, ``upsert_state`` and ``ensure_users`` give it.

    Reads the buckets of the users and projects that the requests name and
    writes the rows that change, all tables in one commit, so a save is there
    with its state or not at all. ``versions.Refused`` if another writer came
    first: call it again, it starts from what is there then. A batch that is
    sent twice makes its new projects once. Users are made for rejected
    requests too; a null user is none.
    """
    base = versions.latest(spark, root)
    # Names and JSON are looked at once, by all tasks; what follows reads what was found.
    checked = written(save_reject_reason(requests.repartition("seq")), "save-requests")
    named = checked.where("reject_reason is null").select(F.coalesce("id", new_id(F.col("user_id"), F.col("seq"))).alias("id"))
    held = versions.read(spark, root, "projects", base, named)
    found = written(judged(held, checked), "judged")
    accepted = written(last_accepted(found), "accepted")
    changed = applied(held, accepted, now, "right_outer")
    senders = checked.select("user_id").distinct()
    known = versions.read(spark, root, "users", base, senders)
    new = ensure_users(known, senders, now).join(known.select("id"), "id", "left_anti")
    state = accepted.select("project_id", "osm_data", "user_edits")
    return versions.commit(spark, root, base, {"users": new, "projects": changed, "state": state}), found.where("reject_reason is not null")


def remove_users(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """The version without users of ``ids`` (user_id), their projects and those projects' state.

    Projects are kept by their own ids, so two columns of all of them are read
    for those of a user; no state is read.
    """
    base = versions.latest(spark, root)
    gone = ids.select("user_id").where("user_id is not null").distinct()
    theirs = versions.read(spark, root, "projects", base).join(gone, "user_id", "left_semi").select("id")
    theirs = written(theirs, "removed-projects")
    return versions.commit(spark, root, base, dropped={"users": gone, "projects": theirs, "state": theirs})
