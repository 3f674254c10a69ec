"""Incremental indexing: change classification, state tables and sinks, as whole-table joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Properties that are compared one by one; null equals null.
PROPERTIES = ("name", "parent_path", "web_url", "mime_type", "size", "last_modified", "sensitivity_label")


def extension_allowed(name: Column, allowed: list[str]) -> Column:
    """Case-insensitive; entries are trimmed and may lack the dot; an empty list allows nothing."""
    wanted = sorted({"." + a.strip().lower().lstrip(".") for a in allowed if a.strip()})
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(wanted)


def same_content(item: str, tracked: str, fingerprint: str) -> Column:
    i, t = (lambda c: F.col(f"{item}.{c}")), (lambda c: F.col(f"{tracked}.{c}"))
    filled = lambda c: F.length(F.trim(c)) > 0
    by_tag = F.when(filled(i("ctag")), i("ctag").eqNullSafe(t("ctag"))).otherwise(filled(i("etag")))
    known = t("item_id").isNotNull() & t("sensitivity_label").isNotNull() & i("etag").eqNullSafe(t("etag"))
    return F.coalesce(known & (t("chunk_count") > 0) & (t("index_fingerprint") == fingerprint) & by_tag, F.lit(False))


def same_properties(item: str, tracked: str, columns: tuple[str, ...] = PROPERTIES) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{item}.{c}").eqNullSafe(F.col(f"{tracked}.{c}")) for c in columns))


def classify(changes: DataFrame, tracked: DataFrame, allowed: list[str], fingerprint: str) -> DataFrame:
    """Each change with its cheapest sufficient action: remove, ignore, skip, merge or reindex."""
    joined = changes.alias("i").join(tracked.alias("t"), (F.col("i.drive_id") == F.col("t.drive_id")) & (F.col("i.item_id") == F.col("t.item_id")), "left")
    same = same_content("i", "t", fingerprint)
    acl = F.col("i.permissions_hash").eqNullSafe(F.col("t.permissions_hash"))
    action = (
        F.when(F.col("i.is_deleted"), "remove")
        .when(~F.col("i.is_file"), "ignore")
        .when(~extension_allowed(F.col("i.name"), allowed), "remove")
        .when(same & same_properties("i", "t") & acl, "skip")
        .when(same, "merge")
        .otherwise("reindex")
    )
    return joined.select("i.*", action.alias("action"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def replace_items(chunks: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """All chunks of the items in ``fresh`` are replaced by its rows."""
    return chunks.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def delete_items(chunks: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return chunks.join(gone.select(*key).distinct(), key, "left_anti")


def merge_metadata(chunks: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks with patched columns, whether every patch found its chunk): never inserts.

    Of several patches of a chunk the last to arrive counts (``arrival``, else the greatest values).
    """
    patches = _last(patches, [key], columns)
    p = patches.select(F.col(key).alias("__k"), F.struct(*columns).alias("__p"))
    joined = chunks.join(p, chunks[key] == p["__k"], "left")
    merged = joined.select(*(F.when(F.col("__k").isNotNull(), F.col(f"__p.{c}")).otherwise(chunks[c]).alias(c) if c in columns else chunks[c] for c in chunks.columns))
    found = patches.join(chunks.select(key), key, "left_anti").agg((F.count(F.lit(1)) == 0).alias("complete"))
    return merged, found


def _last(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    order = [F.desc("arrival")] if "arrival" in rows.columns else []
    return latest(rows, key, [*order, *(F.desc_nulls_last(c) for c in columns)])


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of their key; of several the last to arrive counts (``arrival``, else the greatest values)."""
    rows = _last(rows, key, [c for c in table.columns if c not in key]).select(*table.columns)
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def truncated(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Descriptive columns cut to their widths."""
    return df.withColumns({c: F.left(F.col(c), F.lit(n)) for c, n in widths.items()})


def outside_scan(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files of rounds other than their drive's current one."""
    return files.join(state.select("drive_id", "scan_id"), ["drive_id", "scan_id"], "left_anti")


def sweep(files: DataFrame, state: DataFrame) -> DataFrame:
    """Orphans to delete: files of other rounds, for drives whose round is complete and not yet swept."""
    ready = state.filter((F.length("delta_link") > 0) & ~F.col("scan_id").eqNullSafe(F.col("swept_scan_id")))
    return files.join(ready.select("drive_id", F.col("scan_id").alias("__s")), "drive_id").filter(~F.col("scan_id").eqNullSafe(F.col("__s"))).drop("__s")


def after_sweep(state: DataFrame) -> DataFrame:
    """Sweep markers of complete rounds; others stay."""
    return state.withColumn("swept_scan_id", F.when(F.length("delta_link") > 0, F.col("scan_id")).otherwise(F.col("swept_scan_id")))


def repair_reason(state_status: Column, active_revision: Column, active_version: Column, revision: Column, version: str, pending: Column) -> Column:
    """Why a document's graph must be built again; the first that holds, null if none."""
    return (
        F.when(state_status.isNull(), "missing")
        .when(state_status == "Failed", "failed")
        .when(~active_revision.eqNullSafe(revision), "stale")
        .when(~active_version.eqNullSafe(F.lit(version)), "extractionVersion")
        .when(pending.isNotNull(), "unsettled")
    )
