"""Write-once archives, versioned rows, aliases and catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from .graph import DEFAULT, Ontology, first_by


def archive_once(archive: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """First writer wins: rows of known keys are dropped, and of several new ones the first arrival stays."""
    new = first_by(fresh, key, ["arrival"]).drop("arrival").join(archive.select(*key), key, "left_anti")
    return archive.unionByName(new)


def conditional_write(table: DataFrame, writes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table, conflicts): a write without a token creates, one with a token replaces the row that still has it.

    Rows are (key, token, value), writes may have an ``arrival``; the token of a written row is its new version.  Of several writes of
    one key that may succeed, the first to arrive (else the least value) does, and the others are conflicts.
    """
    t = table.select(F.col(key).alias("__k"), F.col("token").alias("__t"))
    j = writes.join(t, writes[key] == t["__k"], "left")
    ok = F.when(F.col("token").isNull(), F.col("__k").isNull()).otherwise(F.col("__t").eqNullSafe(F.col("token")))
    order = ([F.col("arrival")] if "arrival" in writes.columns else []) + [F.col("value")]
    j = j.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    j = j.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__ok").orderBy(*order)))
    wins = F.col("__ok") & (F.col("__n") == 1)
    done = j.filter(wins).select(key, (F.coalesce(F.col("token"), F.lit(0)) + 1).cast("long").alias("token"), "value")
    return table.join(done.select(key), key, "left_anti").unionByName(done), j.filter(~wins).select(key)


def alias_key(tenant: Column, kind: Column, alias: Column, entity: Column) -> Column:
    return keys.hashed_id(tenant, kind, alias, entity)


def upsert_aliases(aliases: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows (tenant, entity_type, alias, entity_id) are a set."""
    return aliases.unionByName(fresh).dropDuplicates(["tenant", "entity_type", "alias", "entity_id"])


def find_aliases(aliases: DataFrame, wanted: DataFrame, tenant: str, entity_type: str | None = None) -> DataFrame:
    """(alias, entity_ids) of exact matches."""
    a = aliases.filter(F.col("tenant") == tenant)
    a = a if entity_type is None else a.filter(F.col("entity_type") == entity_type)
    return a.join(wanted, "alias").groupBy("alias").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def set_delta_state(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """Links and rounds of drives; the sweep marker stays."""
    old = state.select("drive_id", F.col("swept_scan_id").alias("__s"))
    rows = fresh.join(old, "drive_id", "left").select("drive_id", "delta_link", "scan_id", F.col("__s").alias("swept_scan_id"))
    return state.join(fresh.select("drive_id"), "drive_id", "left_anti").unionByName(rows)


def reset_delta_state(state: DataFrame, drives: list[str]) -> DataFrame:
    """A full walk begins: no link, no sweep marker."""
    hit = F.col("drive_id").isin(*drives)
    return state.withColumn("delta_link", F.when(hit, F.lit("")).otherwise(F.col("delta_link"))).withColumn("swept_scan_id", F.when(hit, F.lit(None)).otherwise(F.col("swept_scan_id")))


def next_scan(state: DataFrame, new_id: Column) -> DataFrame:
    """An empty link starts a round, else the round goes on."""
    return state.withColumn("scan_id", F.when(F.coalesce(F.length("delta_link"), F.lit(0)) > 0, F.col("scan_id")).otherwise(new_id))


def package_hash(files: DataFrame, key: str) -> DataFrame:
    """(key, hash) over the key's files in order of their paths."""
    per = files.select(key, "path", F.sha2("content", 256).alias("h")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "h"))).alias("f"))
    return per.select(key, F.sha2(F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["path"], x["h"])), "\n"), 256).alias("hash"))


def changed_packages(hashes: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Only what differs gets a new version."""
    return hashes.join(stored.select(key, "hash"), [key, "hash"], "left_anti")


def merge_attributes(stored: Column, incoming: Column, most: int = 16) -> Column:
    """Maps: stored values win, new names are added while there is room."""
    s, i = F.coalesce(stored, F.create_map().cast("map<string,string>")), F.coalesce(incoming, F.create_map().cast("map<string,string>"))
    fresh = F.filter(F.array_sort(F.map_keys(i)), lambda k: ~F.map_contains_key(s, k))
    names = F.slice(F.concat(F.array_sort(F.map_keys(s)), fresh), 1, most)
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(s, k), F.element_at(i, k)).alias("value"))))


def flat_catalog(labels: DataFrame) -> DataFrame:
    """(label_id, name) of (id, parent_id, name): children are named ``parent · child``; ids in lower case, last wins."""
    parents = labels.select(F.lower("id").alias("__p"), F.col("name").alias("__n"))
    j = labels.join(parents, F.lower("parent_id") == F.col("__p"), "left")
    named = j.select(F.lower("id").alias("label_id"), F.when(F.col("__n").isNotNull(), F.concat_ws(" · ", "__n", "name")).otherwise(F.col("name")).alias("name"), "position")
    return named.groupBy("label_id").agg(F.max_by("name", "position").alias("name"))


LABEL = r"(?i)^MSIP_Label_([0-9a-f-]{36})_(Enabled|SiteId)$"


def label_of_properties(properties: DataFrame, tenant: str) -> DataFrame:
    """(file_id, label_id): the one enabled label, of the own tenant if any is; null if several are."""
    p = properties.select("file_id", F.lower(F.regexp_extract("name", LABEL, 1)).alias("label_id"), F.lower(F.regexp_extract("name", LABEL, 2)).alias("field"), F.lower("value").alias("value")).filter("label_id <> ''")
    per = p.groupBy("file_id", "label_id").agg(F.bool_or((F.col("field") == "enabled") & (F.col("value") == "true")).alias("on"), F.bool_or((F.col("field") == "siteid") & (F.col("value") == tenant.lower())).alias("own")).filter("on")
    pick = per.groupBy("file_id").agg(F.count_if("own").alias("k"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("own"), F.col("label_id"))).alias("a"), F.max("label_id").alias("b"))
    return pick.select("file_id", F.when(F.col("k") == 1, F.col("a")).when((F.col("k") == 0) & (F.col("n") == 1), F.col("b")).alias("label_id"))


def memoized(rows: DataFrame, key: list[str], score) -> DataFrame:
    """``score`` (DataFrame of distinct keys to one with a result) is called once per key, and joined back."""
    return rows.join(score(rows.select(*key).distinct()), key, "left")


def scored_once(rows: DataFrame, key: list[str], scorer: Callable[[dict], str | None]) -> DataFrame:
    """Rows with ``result`` and ``warning``: ``scorer`` (a dict of the key to a text) is called once per key and may fail.

    A failure is the warning of every row with that key, and of no other; the rest go on.
    """
    import pandas as pd

    def score(frames):
        for f in frames:
            out = []
            for k in f.to_dict("records"):
                try:
                    out.append((scorer(k), None))
                except Exception as e:  # noqa: BLE001  whatever fails in a scorer concerns its own key only
                    out.append((None, f"{type(e).__name__}: {e}"[:1000]))
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(out, columns=["result", "warning"])], axis=1)

    distinct = rows.select(*key).distinct()
    types = ", ".join(f"`{c}` {t}" for c, t in distinct.dtypes)
    scored = distinct.mapInPandas(score, f"{types}, result string, warning string").select(*(F.col(c).alias(f"__{c}") for c in key), "result", "warning")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return rows.join(scored, on, "left").select(*rows.columns, "result", "warning")


def merge_entities(entities: DataFrame, edges_target: tuple[str, str], actor: str) -> tuple[DataFrame, DataFrame]:
    """(entities, history row): source redirects to target; both must exist, be of one type and not be redirected."""
    source, target = edges_target
    rows = {r["entity_id"]: r for r in entities.filter(F.col("entity_id").isin(source, target)).select("entity_id", "entity_type", "redirect_to").collect()}
    if source == target or set(rows) != {source, target} or rows[source]["entity_type"] != rows[target]["entity_type"] or any(r["redirect_to"] for r in rows.values()):
        raise ValueError("two live entities of one type are needed")
    moved = entities.withColumn("redirect_to", F.when(F.col("entity_id") == source, F.lit(target)).otherwise(F.col("redirect_to")))
    return moved, entities.sparkSession.createDataFrame([(source, target, actor)], "source string, target string, actor string")


def capped_history(history: Column, entry: Column, most: int = 20) -> Column:
    """The last entries, the new one at the end."""
    h = F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(entry))
    return F.slice(h, F.greatest(F.size(h) - most + 1, F.lit(1)), most)


def signal_quality(rows: DataFrame, key: list[str]) -> DataFrame:
    """Subscriptions in order: default, tracked and managed first, then by expiry."""
    return rows.orderBy(F.desc("is_default"), F.desc("is_tracked"), F.desc("is_managed"), F.asc_nulls_last("expires_at"), *key)


def instructions(ontology: Ontology = DEFAULT) -> str:
    """Deterministic extraction instructions from an ontology."""
    lines = ["Entity types: " + ", ".join(ontology.types), "Relations:"]
    for r in ontology.relations:
        notes = [n for n, on in (("symmetric", r.symmetric), ("one direction only", r.antisymmetric), ("same type", r.same_type)) if on]
        lines.append(f"- {r.predicate}: {'/'.join(r.subjects)} -> {'/'.join(r.objects)}" + (f" ({', '.join(notes)})" if notes else ""))
    return "\n".join(lines)


def validate_plan(names: list[str], predicates: list[str], ontology: Ontology = DEFAULT) -> list[str]:
    """Allowed predicates of a query plan: all if none is asked for."""
    if len(names) > 20 or any(not 1 <= len(n.strip()) <= 200 for n in names) or len(predicates) > 30:
        raise ValueError("up to 20 names of 1 to 200 characters and up to 30 predicates")
    known = [r.predicate for r in ontology.relations]
    if unknown := sorted(set(predicates) - set(known)):
        raise ValueError(f"unknown predicates: {', '.join(unknown)}")
    return predicates or known


def plan_errors(plans: DataFrame, ontology: Ontology = DEFAULT) -> DataFrame:
    """(question, error, allowed) of plans (question, names, predicates): :func:`validate_plan` for a table of them.

    The first rule that is broken is the error; a sound plan's predicates are those asked for, or all of them.
    """
    names, asked = F.coalesce("names", F.array().cast("array<string>")), F.coalesce("predicates", F.array().cast("array<string>"))
    known = F.array(*(F.lit(r.predicate) for r in ontology.relations))
    bad_name = F.exists(names, lambda n: ~F.coalesce(F.length(F.trim(n)).between(1, 200), F.lit(False)))
    error = F.when(F.size(names) > 20, "names").when(bad_name, "name length").when(F.size(asked) > 30, "predicates").when(F.size(F.array_except(asked, known)) > 0, "unknown predicate")
    allowed = F.when(error.isNull(), F.when(F.size(asked) == 0, known).otherwise(F.array_distinct(asked)))
    return plans.select("question", error.alias("error"), allowed.alias("allowed"))


def seeds(linked: DataFrame, hits: DataFrame, manifests: DataFrame, states: DataFrame, most: int = 10) -> DataFrame:
    """(entity_id, n): linked names first, then ends of the edges that the hits' chunks support; ready documents only."""
    ready = states.filter("status = 'Ready'").select("document_id")
    found = manifests.join(ready, "document_id", "left_semi").join(hits.select("chunk_id", "rank"), "chunk_id")
    flat = found.select(F.lit(1).alias("g"), F.col("rank").alias("r"), "assertion_id", F.posexplode(F.array("subject_id", "object_id")).alias("side", "entity_id"))
    own = linked.select(F.lit(0).alias("g"), F.col("position").alias("r"), F.lit("").alias("assertion_id"), F.lit(0).alias("side"), "entity_id")
    one = own.unionByName(flat).groupBy("entity_id").agg(F.min(F.struct("g", "r", "assertion_id", "side")).alias("o"))
    best = one.orderBy("o", "entity_id").limit(most)
    return best.select("entity_id", F.row_number().over(Window.orderBy("o", "entity_id")).alias("n"))


def assemble(edges: DataFrame, chunks: DataFrame, baseline: DataFrame, most: int = 5, budget: int = 12_000) -> DataFrame:
    """One row of chunk ids: evidence of authorized edges, not in the baseline, each once, within the budget.

    The candidates are those of one bounded traversal, so one array holds them.
    """
    from .retrieval import within_budget

    new = edges.groupBy("chunk_id").agg(F.min(F.struct("depth", "assertion_id")).alias("o")).join(baseline.select("chunk_id"), "chunk_id", "left_anti")
    sized = new.join(chunks.select("chunk_id", F.length("content").alias("size")), "chunk_id")
    listed = sized.agg(F.array_sort(F.collect_list(F.struct("o", "chunk_id", "size"))).alias("c"))
    return listed.select(within_budget(F.transform("c", lambda x: x["chunk_id"]), F.transform("c", lambda x: x["size"]), most, budget).alias("chunk_ids"))
