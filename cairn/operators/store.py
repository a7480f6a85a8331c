"""Stored points, runs and events as tables: upserts, maintenance, states, audit, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, key: str | list[str], version: str, tie: str) -> DataFrame:
    """Full-row replace: of each key the row of the last version (ties: the larger tie column)."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col(tie).desc())
    return rows.withColumn("rn__", F.row_number().over(order)).where("rn__ = 1").drop("rn__")


def merge_points(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace stored ones of the same key; the rest stays. Idempotent."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def preserve(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows, with columns that they lack taken from the stored row of the same key."""
    past = old.select(key, *(F.col(c).alias(f"old__{c}") for c in columns))
    out = new.join(past, key, "left")
    return out.select(*(F.coalesce(c, f"old__{c}").alias(c) if c in columns else c for c in new.columns))


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is neither stored nor met earlier among the new."""
    first = new.withColumn("rn__", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("rn__ = 1").drop("rn__")
    return first.join(stored.select(key).distinct(), key, "left_anti")


def superseded(stored: DataFrame, current: DataFrame, file: str, key: str) -> DataFrame:
    """Stored rows of files that were processed again and whose id is no longer among the current ones."""
    return stored.join(current.select(file).distinct(), file, "left_semi").join(current.select(key), key, "left_anti")


def partial_update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns set that the changes (key, columns) give; nulls there change nothing."""
    fresh = changes.select(key, *(F.col(c).alias(f"new__{c}") for c in columns))
    out = rows.join(fresh, key, "left")
    return out.select(*(F.coalesce(f"new__{c}", c).alias(c) if c in columns else c for c in rows.columns))


def delete_by_id(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def latest_state(events: DataFrame, key: str | list[str], at: str, state: str, tie: str) -> DataFrame:
    """(key, state, started_at, updated_at): the state of the last event; the start of the first never changes."""
    last = F.max_by(F.col(state), F.struct(at, tie))
    return events.groupBy(key).agg(last.alias("state"), F.min(at).alias("started_at"), F.max(at).alias("updated_at"))


def completion(confirmed: Column, expected: Column, failed: Column) -> Column:
    """A document's state from counts: failed wins; done once all expected chunks are confirmed."""
    return F.when(failed > 0, "Failed").when(expected.isNull(), "Processing").when(confirmed >= expected, "Succeeded").otherwise("Processing")


def purge_candidates(events: DataFrame, at: str, cutoff: Column, hold: Column) -> DataFrame:
    """(candidates, held): what a retention purge before the cutoff would delete, and what legal hold keeps."""
    old = F.col(at) < cutoff
    return events.agg(F.count_if(old & ~hold).alias("candidates"), F.count_if(old & hold).alias("held"))


def streaks(events: DataFrame, by: str, order: list[str], bad: Column) -> DataFrame:
    """Events with `streak`: how many bad ones have come in a row, reset by a good one."""
    line = Window.partitionBy(by).orderBy(*order)
    marked = events.withColumn("bad__", bad.cast("int")).withColumn("run__", F.sum(1 - F.col("bad__")).over(line))
    return marked.withColumn("streak", F.sum("bad__").over(Window.partitionBy(by, "run__").orderBy(*order))).drop("bad__", "run__")


def schema_status(dense: Column, sparse: Column, expected: Column, name: str = "dense", summary: str = "dense-resumen", sparse_name: str = "sparse") -> Column:
    """Current, Legacy or Incompatible, of a map of dense vector sizes, an array of sparse names and the model's dimension."""
    bad = dense.isNull() | ~F.coalesce(F.map_contains_key(dense, name), F.lit(False)) | F.coalesce(F.element_at(dense, name) != expected, F.lit(False)) | ~F.coalesce(F.array_contains(sparse, sparse_name), F.lit(False))
    return F.when(bad, "Incompatible").when(~F.map_contains_key(dense, summary), "Legacy").otherwise("Current")


def require_model(manifest_hash: Column, current_hash: Column) -> Column:
    """The hash, or an error that names both where they differ."""
    return F.when(manifest_hash.eqNullSafe(current_hash), current_hash).otherwise(F.raise_error(F.concat(F.lit("model mismatch: stored "), F.coalesce(manifest_hash, F.lit("-")), F.lit(", current "), F.coalesce(current_hash, F.lit("-")))))


def snapshot_digest(rows: DataFrame, key: str, columns: list[str], levels: tuple[int, ...] = (4, 2)) -> DataFrame:
    """(rows, digest): order-free digest of a table: a tree over hashes of canonical rows. A node hashes its children's hashes in their order; nodes are the first hexadecimal digits of a row's hash, as many as `levels` say, then the root."""
    line = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    tree = rows.select(line.alias("h"), line.alias("b"), F.lit(1).cast("long").alias("n"))
    for n in (*levels, 0):
        packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "")
        tree = tree.groupBy(F.substring("b", 1, n).alias("b2")).agg(F.sum("n").alias("n"), F.sha2(packed, 256).alias("h")).select("h", F.col("b2").alias("b"), "n")
    return tree.select(F.col("n").alias("rows"), F.col("h").alias("digest"))


def set_hold(events: DataFrame, changes: DataFrame, key: str, hold: str = "legal_hold") -> DataFrame:
    """Events with the hold that the last of changes(key, hold, at) sets or clears; events that no change names keep theirs."""
    last = changes.groupBy(key).agg(F.max_by(hold, "at").alias("hold__"))
    out = events.join(last, key, "left")
    return out.withColumn(hold, F.coalesce("hold__", hold)).select(*events.columns)


def purge(events: DataFrame, at: str, cutoff: Column, hold: str = "legal_hold") -> DataFrame:
    """What a retention purge leaves: events from the cutoff on, and older ones under hold. One filter, so that no hold can be set between choosing and deleting."""
    return events.where((F.col(at) >= cutoff) | F.coalesce(F.col(hold), F.lit(False)))


def schema_problems(dense: Column, sparse: Column, expected: Column, name: str = "dense", summary: str = "dense-resumen", sparse_name: str = "sparse") -> Column:
    """What is wrong with a collection's schema, in a fixed order; none where it is current."""
    has = lambda n: F.coalesce(F.map_contains_key(dense, n), F.lit(False))
    other = lambda n: has(n) & F.coalesce(F.element_at(dense, n) != expected, F.lit(False))
    size = lambda n: F.concat(F.lit(f"{n} has dimension "), F.element_at(dense, n).cast("string"), F.lit(", expected "), expected.cast("string"))
    said = [F.when(~has(name), f"{name} is missing"), F.when(other(name), size(name)), F.when(~has(summary), f"{summary} is missing"), F.when(other(summary), size(summary)), F.when(~F.coalesce(F.array_contains(sparse, sparse_name), F.lit(False)), f"{sparse_name} is missing")]
    return F.filter(F.array(*said), lambda x: x.isNotNull())
