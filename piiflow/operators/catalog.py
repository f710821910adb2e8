"""Projects, documents and workspaces as tables: keyed changes, versions, stored forms and sweeps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stored documents of this version and older can be read.
VERSION = 1
STORED = (
    "version int, activeProjectId string, projects array<struct<id:string,name:string,createdAt:string,style:string,"
    "documents:array<struct<id:string,name:string,text:string,source:string,format:string>>,"
    "variables:array<struct<id:string,token:string,value:string,kind:string,createdAt:string>>,ignored:array<string>>>"
)


def upsert(rows: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with new ones; where the key exists the new row counts."""
    return rows.join(new.select(*key), list(key), "left_anti").unionByName(new)


def rename(rows: DataFrame, changes: DataFrame, key: Sequence[str] = ("project_id",)) -> DataFrame:
    """rows(name) with changes(new_name); blank names change nothing."""
    c = changes.filter(F.trim("new_name") != "").select(*key, F.trim("new_name").alias("_new"))
    return rows.join(c, list(key), "left").withColumn("name", F.coalesce("_new", "name")).drop("_new")


def remove(rows: DataFrame, gone: DataFrame, key: Sequence[str] = ("project_id",)) -> DataFrame:
    return rows.join(gone.select(*key), list(key), "left_anti")


def remove_workspaces(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables of a workspace go with it: each by name, without the workspaces of gone."""
    return {name: remove(table, gone, ("workspace",)) for name, table in tables.items()}


def page_source(form: Column, kept: Column) -> Column:
    """Where a document's pages come from: the kept file, drawn anew, or null where it has none."""
    return F.when((form == "pdf") & kept, "kept").when(form == "docx", "drawn")


def active_after_removal(projects: DataFrame, active: DataFrame) -> DataFrame:
    """Each workspace's active project: the one named in active, or its first if that is gone."""
    first = projects.groupBy("workspace").agg(F.min_by("project_id", "project_order").alias("_first"))
    kept = active.join(projects.select("workspace", F.col("project_id").alias("active_id")), ["workspace", "active_id"], "left_semi")
    return first.join(kept, "workspace", "left").select("workspace", F.coalesce("active_id", "_first").alias("active_id"))


def as_of(versions: DataFrame, at: Column, key: Sequence[str] = ("project_id",)) -> DataFrame:
    """The state of each key at a version: undo and redo are reads of versions(version, ..., deleted)."""
    latest = Window.partitionBy(*key).orderBy(F.col("version").desc())
    rows = versions.filter(F.col("version") <= at).withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
    return rows.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def last_writes(writes: DataFrame, key: Sequence[str] = ("workspace",)) -> DataFrame:
    """Of several writes of a key the last one."""
    order = Window.partitionBy(*key).orderBy(F.col("version").desc(), F.col("body").desc())
    return writes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def parse_stored(stored: DataFrame) -> DataFrame:
    """stored(workspace, body) as the workspace's data, and status: ok, blank, unreadable or newer.

    Missing lists become empty ones. What can't be read keeps its body, and is never overwritten blindly.
    """
    df = stored.withColumn("data", F.from_json("body", STORED + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    status = (
        F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "blank").when(F.col("data").isNull() | F.col("data._corrupt").isNotNull(), "unreadable")
        .when(F.coalesce("data.version", F.lit(0)) > VERSION, "newer").otherwise("ok")
    )
    projects = F.coalesce(F.when(status == "ok", F.col("data.projects")), F.array().cast(df.schema["data"].dataType["projects"].dataType))
    active = F.coalesce(F.col("data.activeProjectId"), F.get(projects, 0)["id"])
    return df.select("workspace", "body", status.alias("status"), projects.alias("projects"), F.when(status == "ok", active).alias("active_id"))


def serialize(workspaces: DataFrame) -> DataFrame:
    """workspaces(workspace, active_id, projects) as stored(workspace, body)."""
    body = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.col("active_id").alias("activeProjectId"), "projects"))
    return workspaces.select("workspace", body.alias("body"))


def folder_plan(folder: DataFrame, device: DataFrame) -> DataFrame:
    """What opening a folder does for each workspace: push, adopt, ask or unreadable.

    folder(workspace, folder_text, folder_projects, readable, fresh); device(workspace, device_projects).
    The projects are their stored form, "[]" or null for none.
    """
    df = device.join(folder, "workspace", "full")
    none = lambda c: F.coalesce(F.col(c), F.lit("[]")) == "[]"
    action = (
        F.when(F.coalesce(F.trim("folder_text"), F.lit("")) == "", "push").when(~F.coalesce("readable", F.lit(False)), "unreadable").when(none("folder_projects"), "push")
        .when(F.col("folder_projects").eqNullSafe(F.col("device_projects")), "adopt").when(F.coalesce("fresh", F.lit(False)) & ~none("device_projects"), "ask").otherwise("adopt")
    )
    return df.select("workspace", action.alias("action"))


def sweep(vault: DataFrame, live: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Files of vault(doc_id) that no live(doc_id) document has; none while a workspace(readable) can't be read."""
    unread = workspaces.filter(~F.col("readable")).limit(1).select(F.lit(True).alias("_unread"))
    return vault.join(live.select("doc_id"), "doc_id", "left_anti").join(unread, F.lit(True), "left_anti")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Operations in order; those of a session lie together. What is held are the numbers of its commits."""
    session, past, current, future, what = None, [], None, [], None
    states: dict[int | None, int | None] = {}
    for batch in batches:
        at, undo, redo = [], [], []
        for key, seq, op, state in zip(*(batch[c].to_pylist() for c in ("_session", "_seq", "_op", "_state"))):
            if key != session:
                session, past, current, future, states = key, [], None, [], {None: None}
            if op == "commit" and (current is None or states[current] != state):
                past.append(current)
                current, future = seq, []
                states[seq] = state
            elif op == "undo" and past:
                future.append(current)
                current = past.pop()
            elif op == "redo" and future:
                past.append(current)
                current = future.pop()
            at.append(current)
            undo.append(bool(past))
            redo.append(bool(future))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("_session", "_seq")), pa.array(at, pa.int64()), pa.array(undo), pa.array(redo)], ["_session", "_seq", "_at", "_undo", "_redo"])


def replay(log: DataFrame, state: Column, key: Sequence[str] = ("workspace",)) -> DataFrame:
    """log(seq, op) with what holds after each operation: current, the seq of the commit whose state is shown, can_undo and can_redo.

    op: commit takes a new state, undo and redo move between those there were, and switch leaves the history behind. Without a commit,
    current is null: the state that was loaded. A commit after undo cuts off what could be redone; one that changes nothing, an undo
    at the beginning and a redo at the end do nothing. Other operations, such as navigation, change no history.

    seq is unique for a key. Operations are ordered within their session (from one switch to the next) and read once; a session is one task's work,
    as each of its states depends on the one before.
    """
    order = Window.partitionBy(*key).orderBy("seq")
    switches = F.sum(F.when(F.col("op") == "switch", 1).otherwise(0)).over(order)
    rows = log.withColumn("_session", F.to_json(F.struct(*key, switches.alias("switch"))))
    asked = rows.select("_session", F.col("seq").cast("long").alias("_seq"), F.col("op").alias("_op"), F.xxhash64(state).alias("_state"))
    played = asked.repartition("_session").sortWithinPartitions("_session", "_seq").mapInArrow(_replayed, "_session string, _seq long, _at long, _undo boolean, _redo boolean")
    joined = rows.join(played, (rows["_session"] == played["_session"]) & (rows["seq"] == played["_seq"]))
    return joined.select(*[rows[c] for c in log.columns], F.col("_at").alias("current"), F.col("_undo").alias("can_undo"), F.col("_redo").alias("can_redo"))
