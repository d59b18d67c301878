"""The project store as keyed upserts: every function returns new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import new_id
from .validate import save_reject_reason


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def ensure_users(users: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Users with those of ``ids`` (user_id) that were not there; known ones stay as they are."""
    new = ids.select(F.col("user_id").alias("id")).where("id is not null").distinct().join(users, "id", "left_anti")
    return users.unionByName(new.select("id", F.col("id").alias("clerk_id"), F.lit(None).cast("string").alias("email"), now.cast("timestamp").alias("created_at")))


def save_projects(projects: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, rejected, accepted) after a batch of save requests.

    A request without an id makes a project, whose id follows from user and
    seq. One with an id changes it only if that project is the user's own;
    it never makes one. Of several for a project the last counts. Accepted
    requests carry ``project_id`` for ``upsert_state``.
    """
    found = judged(projects, save_reject_reason(requests))
    accepted = last_accepted(found)
    return applied(projects, accepted, now), found.where("reject_reason is not null"), accepted


def judged(projects: DataFrame, checked: DataFrame) -> DataFrame:
    """Requests that ``save_reject_reason`` has seen, those for projects that are not the user's own rejected as well."""
    owned = projects.select("id", "user_id", F.lit(True).alias("__owned"))
    found = checked.join(owned, ["id", "user_id"], "left")
    reason = F.coalesce("reject_reason", F.when(F.col("id").isNotNull() & F.col("__owned").isNull(), "NOT_FOUND"))
    return found.withColumn("reject_reason", reason).drop("__owned")


def last_accepted(found: DataFrame) -> DataFrame:
    """Of the requests that are not rejected the last for each project, with ``project_id``."""
    good = found.where("reject_reason is null").withColumn("project_id", F.coalesce("id", new_id(F.col("user_id"), F.col("seq"))))
    return latest_per_key(good, ["project_id"], "seq")


def applied(projects: DataFrame, accepted: DataFrame, now: Column, how: str = "full_outer") -> DataFrame:
    """Projects after the accepted requests; with ``right_outer`` the changed ones only."""
    changed = accepted.select(F.col("project_id").alias("id"), F.col("user_id").alias("__user"), F.col("name").alias("__name"), F.col("bbox").alias("__bbox"))
    joined = projects.join(changed, "id", how)
    hit = F.col("__user").isNotNull()
    stamp = now.cast("timestamp")
    return joined.select(
        "id",
        F.coalesce("user_id", "__user").alias("user_id"),
        F.when(hit, F.col("__name")).otherwise(F.col("name")).alias("name"),
        F.when(hit, F.col("__bbox")).otherwise(F.col("bbox")).alias("bbox"),
        F.when(F.col("user_id").isNull(), stamp).otherwise(F.col("created_at")).alias("created_at"),
        F.when(hit, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upsert_state(state: DataFrame, accepted: DataFrame) -> DataFrame:
    """State with that of the accepted requests in place of the projects' old one."""
    new = latest_per_key(accepted, ["project_id"], "seq").select("project_id", "osm_data", "user_edits")
    return state.join(new, "project_id", "left_anti").unionByName(new)


def delete_users(store: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The store without users of ``ids`` (user_id), their projects and those projects' state."""
    gone = ids.select("user_id").distinct()
    projects = store["projects"].join(gone, "user_id", "left_anti")
    dropped = store["projects"].join(gone, "user_id", "left_semi").select(F.col("id").alias("project_id"))
    users = store["users"].join(gone, F.col("id") == F.col("user_id"), "left_anti")
    return {"users": users, "projects": projects.select(*store["projects"].columns), "state": store["state"].join(dropped, "project_id", "left_anti")}


def list_projects(projects: DataFrame, user_id: str) -> DataFrame:
    """A user's projects, changed last first."""
    return projects.where(F.col("user_id") == user_id).select("id", "name", "bbox", "created_at", "updated_at").orderBy(F.desc("updated_at"), "id")


def get_project(projects: DataFrame, state: DataFrame, project_id: str, user_id: str) -> DataFrame:
    """A user's project with its state: one row, or none."""
    own = projects.where((F.col("id") == project_id) & (F.col("user_id") == user_id))
    return own.join(state, own["id"] == state["project_id"]).drop("project_id").limit(1)


def open_projects(projects: DataFrame, state: DataFrame, asked: DataFrame) -> DataFrame:
    """Batch form: a row for each (id, user_id) asked for, nulls where it is not the user's."""
    own = projects.join(state, projects["id"] == state["project_id"]).drop("project_id")
    return asked.join(own, ["id", "user_id"], "left")
