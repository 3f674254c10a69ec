"""Extraction results on their way into the graph: grounding, assertion building and snapshot validation.

All of it works on tables of many documents at once.  A snapshot is one document revision; its header, entities,
assertions and resolutions are rows that carry ``document_id`` and their 0-based ``position``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, text
from .graph import DEFAULT, Ontology, first_by, same_types

SCHEMA_VERSION = 1
#: Headers that are broadcast; beyond that rows meet them by a shuffle.
MOST_BROADCAST = 500_000
METHODS = ("Identifier", "Alias", "New", "Ambiguous")


@dataclass(frozen=True)
class Limits:
    """Bounds of one document's snapshot (fixed values)."""

    entities: int = 500
    assertions: int = 1000
    name: int = 256
    aliases: int = 20
    attributes: int = 16
    attribute_value: int = 256
    section: int = 512
    version: int = 128
    errors: int = 100
    resolutions: int = 2000
    candidates: int = 10


def _blank(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) == 0


def _rule(code: str, bad: Column, path: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), path.alias("path")))


def _found(rows: DataFrame, rules: list[Column]) -> DataFrame:
    """(document_id, code, path) of the rules that hold: one pass over the rows."""
    return rows.select("document_id", F.explode(F.array_compact(F.array(*rules))).alias("e")).select("document_id", "e.*")


def _at(kind: str, field: str | None = None) -> Column:
    path = F.concat(F.lit(f"{kind}["), F.col("position").cast("string"), F.lit("]"))
    return path if field is None else F.concat(path, F.lit(f".{field}"))


def _safe(c: Column) -> Column:
    return keys.storage_safe(F.coalesce(c, F.lit("")))


def _version(c: Column, path: str, most: int) -> list[Column]:
    return [_rule("required", _blank(c), F.lit(path)), _rule("limit.exceeded", F.length(c) > most, F.lit(path))]


def _listed(rows: DataFrame, kind: str, headers: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of lists within the limit, errors of the lists that exceed it)."""
    long = rows.groupBy("document_id").count().filter(F.col("count") > most).select("document_id")
    errors = long.join(headers.select("document_id"), "document_id", "left_semi").select("document_id", F.lit("limit.exceeded").alias("code"), F.lit(kind).alias("path"))
    # There are fewer such lists than rows by the limit, so the rows stay where they are.
    return rows.join(F.broadcast(long), "document_id", "left_anti"), errors


def _first_of(rows: DataFrame, column: str) -> DataFrame:
    """With __repeat: whether an earlier row of the snapshot has the same value."""
    w = Window.partitionBy("document_id", column).orderBy("position")
    return rows.withColumn("__repeat", F.col(column).isNotNull() & (F.row_number().over(w) > 1))


def _elements(rows: DataFrame, column: str, rule: Callable[[], list[Column]]) -> DataFrame:
    return _found(rows.select("document_id", "position", "entity_type", F.posexplode(column).alias("i", "value")), rule())


def validate(headers: DataFrame, entities: DataFrame, assertions: DataFrame, resolutions: DataFrame, ontology: Ontology = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    """(document_id, code, path) of everything that is wrong, up to ``limits.errors`` for each snapshot.

    headers: (document_id, tenant, document_version, schema_version, ontology_version, extraction_version);
    entities: (entity_id, entity_type, tenant, canonical_name, aliases, attributes); assertions: (assertion_id, tenant,
    subject_id, predicate, object_id, status, ontology_version, extraction_version, evidence); resolutions:
    (local_ref, entity_id, method, candidates).  Every rule is a condition on a row or a join with the snapshot's entities.
    """
    h = headers.select("document_id", *(F.col(c).alias(f"h_{c}") for c in ("tenant", "document_version", "ontology_version", "extraction_version")))
    h = F.broadcast(h) if h.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else h
    out = [_found(headers, [
        _rule("identifier.invalid", ~_safe(F.col("tenant")), F.lit("tenantId")),
        _rule("identifier.invalid", keys.document_parts(F.col("document_id")).isNull(), F.lit("documentId")),
        _rule("schema.version", ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), F.lit("schemaVersion")),
        _rule("ontology.version", ~F.col("ontology_version").eqNullSafe(F.lit(ontology.version)), F.lit("extraction.ontologyVersion")),
        *_version(F.col("document_version"), "documentVersion", limits.version),
        *_version(F.col("extraction_version"), "extraction.extractionVersion", limits.version),
    ])]
    if bad := ontology.errors():
        out.append(headers.select("document_id", F.explode(F.array(*map(F.lit, bad))).alias("path")).select("document_id", F.lit("ontology.invalid").alias("code"), "path"))

    entities, long = _listed(entities, "entities", headers, limits.entities)
    e = _first_of(entities.join(h, "document_id"), "entity_id")
    known_type = F.coalesce(F.col("entity_type").isin(*ontology.types), F.lit(False))
    prefix = F.concat(F.lower("entity_type"), F.lit(":"))
    other_tenant = ~F.col("tenant").eqNullSafe(F.col("h_tenant"))
    bad_id, wrong_prefix = ~_safe(F.col("entity_id")), known_type & ~F.startswith(F.col("entity_id"), prefix)
    out += [long, _found(e, [
        _rule("tenant.mismatch", other_tenant, _at("entities", "tenantId")),
        _rule("identifier.invalid", bad_id, _at("entities", "entityId")),
        _rule("id.duplicate", ~bad_id & F.col("__repeat"), _at("entities", "entityId")),
        _rule("entityType.unknown", ~known_type, _at("entities", "entityType")),
        _rule("entity.idType", wrong_prefix, _at("entities", "entityId")),
        _rule("required", _blank(F.col("canonical_name")), _at("entities", "canonicalName")),
        _rule("limit.exceeded", F.length("canonical_name") > limits.name, _at("entities", "canonicalName")),
        _rule("required", F.col("aliases").isNull(), _at("entities", "aliases")),
        _rule("limit.exceeded", F.size("aliases") > limits.aliases, _at("entities", "aliases")),
        _rule("required", known_type & F.col("attributes").isNull(), _at("entities", "attributes")),
        _rule("limit.exceeded", known_type & (F.size("attributes") > limits.attributes), _at("entities", "attributes")),
    ])]
    place = lambda field: F.concat(_at("entities", field), F.lit("["), F.col("i").cast("string"), F.lit("]"))
    aliases = e.filter(F.size("aliases") <= limits.aliases).select("document_id", "position", F.posexplode("aliases").alias("i", "value"))
    aliases = aliases.withColumn("normal", keys.normalize_name(F.coalesce("value", F.lit(""))))
    aliases = aliases.withColumn("__again", F.row_number().over(Window.partitionBy("document_id", "position", "normal").orderBy("i")) > 1)
    out.append(_found(aliases, [
        _rule("required", _blank(F.col("value")), place("aliases")),
        _rule("limit.exceeded", F.length("value") > limits.name, place("aliases")),
        _rule("entity.aliasDuplicate", ~_blank(F.col("value")) & F.col("__again"), place("aliases")),
    ]))
    own = F.create_map(*(x for t, names in ontology.attributes for x in (F.lit(t), F.array(*map(F.lit, names))))) if ontology.attributes else F.create_map().cast("map<string,array<string>>")
    allowed = F.coalesce(F.array_contains(F.element_at(own, F.col("entity_type")), F.col("value.key")), F.lit(False))
    entries = e.filter(known_type & (F.size("attributes") <= limits.attributes)).withColumn("entries", F.array_sort(F.map_entries("attributes")))
    out.append(_elements(entries, "entries", lambda: [
        _rule("entity.attribute", ~allowed, place("attributes")),
        _rule("limit.exceeded", allowed & (_blank(F.col("value.value")) | (F.length("value.value") > limits.attribute_value)), place("attributes")),
    ]))
    valid = e.filter(~other_tenant & ~bad_id & ~F.col("__repeat") & known_type & ~wrong_prefix).select("document_id", "entity_id", "entity_type")

    assertions, long = _listed(assertions, "assertions", headers, limits.assertions)
    a = assertions.join(h, "document_id")
    x, ev = F.col("evidence"), (lambda c: F.col(f"evidence.{c}"))
    known = F.coalesce(F.col("predicate").isin(*(r.predicate for r in ontology.relations)), F.lit(False))
    symmetric = F.coalesce(F.col("predicate").isin(*ontology.symmetric), F.lit(False)) if ontology.symmetric else F.lit(False)
    ends = F.col("__subject").isNotNull() & F.col("__object").isNotNull() & known
    self_relation = F.col("subject_id") == F.col("object_id")
    bad_key = ~(_safe(F.col("assertion_id")) & F.startswith(F.col("assertion_id"), F.lit("assertion:")))
    derived = keys.assertion_id_column(ev("tenant"), ev("document_id"), ev("document_version"), ev("chunk_id"), F.col("subject_id"), F.col("predicate"), F.col("object_id"), symmetric)
    elsewhere = ~(ev("document_id").eqNullSafe(F.col("document_id")) & ev("document_version").eqNullSafe(F.col("h_document_version")))
    sound = x.isNotNull() & ev("tenant").eqNullSafe(F.col("h_tenant")) & ~elsewhere & _safe(ev("chunk_id"))
    # What a row shows by itself is judged where it lies; only what the other rules need meets the rest of its snapshot.
    narrow = a.select("document_id", "position", "subject_id", "object_id", "predicate", "assertion_id", bad_key.alias("__bad"), (sound & (F.col("assertion_id") != derived)).alias("__moved"))
    met = _first_of(narrow, "assertion_id").drop("assertion_id")
    for side in ("subject", "object"):
        met = met.join(valid.select("document_id", F.col("entity_id").alias(f"{side}_id"), F.col("entity_type").alias(f"__{side}")), ["document_id", f"{side}_id"], "left")
    out += [long, _found(a, [
        _rule("tenant.mismatch", other_tenant, _at("assertions", "tenantId")),
        _rule("assertion.status", ~F.coalesce(F.col("status").isin("Asserted", "Disputed"), F.lit(False)), _at("assertions", "status")),
        _rule("ontology.version", ~F.col("ontology_version").eqNullSafe(F.lit(ontology.version)), _at("assertions", "ontologyVersion")),
        _rule("extraction.version", ~F.col("extraction_version").eqNullSafe(F.col("h_extraction_version")), _at("assertions", "extractionVersion")),
        _rule("predicate.unknown", ~known, _at("assertions", "predicate")),
        _rule("required", x.isNull(), _at("assertions", "evidence")),
        _rule("tenant.mismatch", x.isNotNull() & ~ev("tenant").eqNullSafe(F.col("h_tenant")), _at("assertions", "evidence.tenantId")),
        _rule("evidence.document", x.isNotNull() & elsewhere, _at("assertions", "evidence")),
        _rule("identifier.invalid", x.isNotNull() & ~_safe(ev("chunk_id")), _at("assertions", "evidence.chunkId")),
        _rule("evidence.invalid", x.isNotNull() & ~F.coalesce(keys.is_content_hash(ev("chunk_content_hash")), F.lit(False)), _at("assertions", "evidence.chunkContentHash")),
        _rule("evidence.invalid", ev("page") < 1, _at("assertions", "evidence.pageNumber")),
        _rule("evidence.invalid", ev("section").isNotNull() & (_blank(ev("section")) | (F.length(ev("section")) > limits.section)), _at("assertions", "evidence.section")),
        _rule("evidence.invalid", ev("access_scope_ref").isNotNull() & ~_safe(ev("access_scope_ref")), _at("assertions", "evidence.accessScopeRef")),
        _rule("identifier.invalid", bad_key, _at("assertions", "assertionId")),
    ]), _found(met, [
        _rule("assertion.entityReference", F.col("__subject").isNull(), _at("assertions", "subjectEntityId")),
        _rule("assertion.entityReference", F.col("__object").isNull(), _at("assertions", "objectEntityId")),
        _rule("assertion.relation", ends & ~ontology.allows(F.col("__subject"), F.col("predicate"), F.col("__object")), _at("assertions")),
        _rule("assertion.selfReference", ends & self_relation, _at("assertions")),
        _rule("assertion.symmetricOrientation", ends & symmetric & (F.col("subject_id") > F.col("object_id")), _at("assertions")),
        _rule("id.duplicate", ~F.col("__bad") & F.col("__repeat"), _at("assertions", "assertionId")),
        _rule("assertion.id", ~F.col("__bad") & ~F.col("__repeat") & ends & F.col("__moved"), _at("assertions", "assertionId")),
    ])]

    resolutions, long = _listed(resolutions, "resolutions", headers, limits.resolutions)
    r = _first_of(resolutions.join(h.select("document_id"), "document_id"), "local_ref")
    r = r.join(valid.select("document_id", "entity_id", F.lit(True).alias("__known")), ["document_id", "entity_id"], "left")
    out += [long, _found(r, [
        _rule("resolution.invalid", ~_safe(F.col("local_ref")) | (F.length("local_ref") > 128) | F.col("__repeat"), _at("resolutions", "localRef")),
        _rule("resolution.invalid", F.col("__known").isNull(), _at("resolutions", "entityId")),
        _rule("resolution.invalid", ~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)), _at("resolutions", "method")),
        _rule("resolution.invalid", F.col("candidates").isNull() | (F.size("candidates") > limits.candidates) | F.exists("candidates", lambda c: ~_safe(c)), _at("resolutions", "candidateEntityIds")),
    ])]
    errors = reduce(lambda p, q: p.unionByName(q), out)
    w = Window.partitionBy("document_id").orderBy("path", "code")
    return errors.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limits.errors).drop("__n")


def ontology_errors(types: DataFrame, relations: DataFrame) -> DataFrame:
    """(ontology_id, error) of what is wrong with many ontologies at once, in the words of :meth:`Ontology.errors`.

    types: (ontology_id, position, name); relations: (ontology_id, position, predicate, subjects, objects, symmetric,
    antisymmetric, same_type).  Every rule is a condition on a row, a repeat of an earlier one, or a join with the ontology's types.
    """
    say = lambda cond, *parts: F.when(F.coalesce(cond, F.lit(False)), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    told = lambda rows, *errors: rows.select("ontology_id", F.explode(F.array_compact(F.array(*errors))).alias("error"))
    at = F.col("position").cast("string")
    t = types.withColumn("__again", F.row_number().over(Window.partitionBy("ontology_id", "name").orderBy("position")) > 1)
    name = F.coalesce("name", F.lit(""))
    out = told(t, say(~name.rlike("^[A-Z][A-Za-z0-9]{0,63}$"), "types[", at, "]: bad name ", name), say(F.col("__again"), "types[", at, "]: duplicate type ", name))
    known = types.groupBy("ontology_id").agg(F.collect_set("name").alias("__known"))
    r = relations.withColumn("__again", F.row_number().over(Window.partitionBy("ontology_id", "predicate").orderBy("position")) > 1).join(known, "ontology_id", "left")
    r = r.withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))
    where, predicate = F.concat(F.lit("relations["), at, F.lit("]: ")), F.coalesce("predicate", F.lit(""))
    sound = predicate.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$") & (F.length(predicate) <= 64)
    out = out.unionByName(told(
        r, say(~sound, where, "bad predicate ", predicate), say(F.col("__again"), where, "duplicate predicate ", predicate),
        *(say(F.size(side) <= 0, where, "a side without types") for side in ("subjects", "objects")),
        say(F.col("symmetric") & ~same_types(F.col("subjects"), F.col("objects")), where, "a symmetric relation has the same types on both sides"),
        say(F.col("symmetric") & F.col("antisymmetric"), where, "symmetric and antisymmetric"),
        say(F.col("same_type") & ~F.arrays_overlap("subjects", "objects"), where, "one type on both ends, but no type is on both"),
    ))
    for side in ("subjects", "objects"):
        each = r.select("ontology_id", where.alias("w"), F.explode(F.array_except(side, "__known")).alias("x"))
        out = out.unionByName(each.select("ontology_id", F.concat("w", F.lit("unknown type "), "x").alias("error")))
    return out


REF = "^[A-Za-z0-9_-]{1,64}$"


def ground(chunks: DataFrame, entities: DataFrame, relations: DataFrame, ontology: Ontology = DEFAULT, most_entities: int = 50, most_relations: int = 100, most_name: int = 256, most_aliases: int = 10) -> tuple[DataFrame, DataFrame]:
    """(kept entities, kept relations) of each chunk's extraction.

    chunks: (chunk_id, content); entities: (chunk_id, position, ref, type, name, aliases, attributes); relations: (chunk_id,
    position, subject_ref, predicate, object_ref, quote).  A name, alias or attribute value must occur in the chunk, a quote
    as well; the first entity of a reference counts, and the first ``most_*`` that hold.  An entity without a relation is kept
    only if it brings an alias or an attribute.
    """
    folded = chunks.select("chunk_id", keys.fold_text("content").alias("__t"))
    has = lambda c: (F.length(c) > 0) & F.contains(F.col("__t"), c)
    e = entities.join(folded, "chunk_id").withColumn("__f", keys.fold_text(F.col("name")))
    e = e.filter(F.coalesce(F.col("ref").rlike(REF) & F.col("type").isin(*ontology.types) & ~_blank(F.col("name")) & (F.length("name") <= most_name) & has(F.col("__f")), F.lit(False)))
    e = first_by(e, ["chunk_id", "ref"], ["position"])
    e = e.withColumn("__n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("position"))).filter(F.col("__n") <= most_entities).withColumn("name", F.trim("name"))
    normal = e.select("chunk_id", "ref", "__t", keys.normalize_name(F.col("name")).alias("__own"), F.posexplode("aliases").alias("i", "alias")).filter(~_blank(F.col("alias")) & (F.length("alias") <= most_name))
    normal = normal.withColumn("__f", keys.fold_text(F.col("alias"))).withColumn("__a", keys.normalize_name(F.col("alias"))).filter(has(F.col("__f")) & (F.col("__a") != F.col("__own")))
    normal = first_by(normal, ["chunk_id", "ref", "__a"], ["i"])
    listed = normal.groupBy("chunk_id", "ref").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("i", F.trim("alias").alias("alias")))), 1, most_aliases), lambda x: x["alias"]).alias("__aliases"))
    own = F.create_map(*(x for t, names in ontology.attributes for x in (F.lit(t), F.array(*map(F.lit, names))))) if ontology.attributes else F.create_map().cast("map<string,array<string>>")
    at = e.select("chunk_id", "ref", "__t", "type", F.explode(F.map_entries("attributes")).alias("x")).filter(F.coalesce(F.array_contains(F.element_at(own, F.col("type")), F.col("x.key")), F.lit(False)))
    at = at.withColumn("__f", keys.fold_text(F.col("x.value"))).filter(~_blank(F.col("x.value")) & (F.length("x.value") <= 256) & has(F.col("__f")))
    at = at.groupBy("chunk_id", "ref").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("x.key").alias("key"), F.trim("x.value").alias("value"))))).alias("__attributes"))
    e = e.join(listed, ["chunk_id", "ref"], "left").join(at, ["chunk_id", "ref"], "left")
    e = e.select("chunk_id", "position", "ref", "type", "name", F.coalesce("__aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("__attributes", F.create_map().cast("map<string,string>")).alias("attributes"))

    r = relations.join(folded, "chunk_id").withColumn("predicate", keys.normalize_predicate(F.coalesce("predicate", F.lit("")))).withColumn("__q", keys.fold_text(F.coalesce("quote", F.lit(""))))
    side = lambda s: e.select("chunk_id", F.col("ref").alias(f"{s}_ref"), F.col("type").alias(f"__{s}"))
    r = r.join(side("subject"), ["chunk_id", "subject_ref"]).join(side("object"), ["chunk_id", "object_ref"])
    r = r.filter(ontology.allows(F.col("__subject"), F.col("predicate"), F.col("__object")) & (F.col("subject_ref") != F.col("object_ref")) & text.grounded_quote(F.col("__t"), F.col("__q")))
    r = first_by(r, ["chunk_id", "subject_ref", "predicate", "object_ref"], ["position"])
    r = r.withColumn("__n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("position"))).filter(F.col("__n") <= most_relations)
    r = r.select("chunk_id", "position", "subject_ref", "predicate", "object_ref")
    related = r.select("chunk_id", F.explode(F.array("subject_ref", "object_ref")).alias("ref")).distinct().withColumn("__r", F.lit(True))
    kept = e.join(related, ["chunk_id", "ref"], "left").filter(F.col("__r") | (F.size("aliases") > 0) | (F.size("attributes") > 0)).drop("__r")
    return kept, r


def build_assertions(relations: DataFrame, decisions: DataFrame, chunks: DataFrame, ontology: Ontology = DEFAULT, extraction_version: str = "v1") -> DataFrame:
    """Assertions of grounded relations: references give way to their entities, and the first of each id stays.

    relations: (chunk_id, position, subject_ref, predicate, object_ref); decisions: (chunk_id, ref, entity_id, entity_type);
    chunks: (chunk_id, chunk_number, tenant, document_id, document_version, content, access_scope_ref).  Two references to one entity, or to
    types that the relation no longer allows, give none; a symmetric relation's subject is the end that sorts first.
    """
    # A chunk's few decisions are gathered, so that relations, decisions and chunks meet by the chunk alone.
    known = decisions.repartition("chunk_id").groupBy("chunk_id").agg(F.collect_set(F.struct("ref", "entity_id", "entity_type")).alias("__known"))
    j = relations.join(known, "chunk_id").join(chunks, "chunk_id")
    for side in ("subject", "object"):
        own = F.col(f"{side}_ref")
        j = j.withColumn("__one", F.explode(F.filter("__known", lambda x: x["ref"] == own))).withColumns({f"{side}_id": F.col("__one.entity_id"), f"__{side}": F.col("__one.entity_type")})
    j = j.drop("__known", "__one", "subject_ref", "object_ref")
    j = j.filter((F.col("subject_id") != F.col("object_id")) & ontology.allows(F.col("__subject"), F.col("predicate"), F.col("__object")))
    symmetric = F.col("predicate").isin(*ontology.symmetric) if ontology.symmetric else F.lit(False)
    turn = symmetric & (F.col("subject_id") > F.col("object_id"))
    j = j.withColumns({"subject_id": F.when(turn, F.col("object_id")).otherwise(F.col("subject_id")), "object_id": F.when(turn, F.col("subject_id")).otherwise(F.col("object_id"))})
    j = j.withColumn("assertion_id", keys.assertion_id_column(F.col("tenant"), F.col("document_id"), F.col("document_version"), F.col("chunk_id"), F.col("subject_id"), F.col("predicate"), F.col("object_id"), symmetric))
    j = first_by(j, ["document_id", "assertion_id"], ["chunk_number", "position"])
    none = lambda t: F.lit(None).cast(t)
    evidence = F.struct("tenant", "document_id", "document_version", "chunk_id", keys.content_hash(F.col("content")).alias("chunk_content_hash"), none("string").alias("section"), none("int").alias("page"), "access_scope_ref")
    return j.select("document_id", "assertion_id", "tenant", "subject_id", "predicate", "object_id", evidence.alias("evidence"), F.lit("Asserted").alias("status"), F.lit(ontology.version).alias("ontology_version"), F.lit(extraction_version).alias("extraction_version"))


def extract(chunks: DataFrame, extractor: Callable[[DataFrame], tuple[DataFrame, DataFrame]], **bounds) -> tuple[DataFrame, DataFrame]:
    """Grounded (entities, relations) of whatever ``extractor`` finds in the chunks; it may be a model call in an Arrow function."""
    return ground(chunks, *extractor(chunks), **bounds)


def plan_query(question: str, planner: Callable[[str], tuple[list[str], list[str]]], ontology: Ontology = DEFAULT) -> tuple[list[str], list[str]]:
    """(names, predicates) by a pluggable planner, checked against the ontology."""
    from .state import validate_plan

    names, predicates = planner(question)
    return names, validate_plan(names, predicates, ontology)


def consistent(files: DataFrame, chunks: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that may be read, (document_id, reason) of those that must be tried again).

    files: (document_id, revision, chunk_count) as tracked when the pass began; current: the same, read again.  A number of
    chunks other than the tracked one, or a revision that moved, means that a rewrite is under way.
    """
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("__n"))
    again = current.select("document_id", F.col("revision").alias("__r"))
    j = files.join(counts, "document_id", "left").join(again, "document_id", "left")
    reason = F.when(F.coalesce("__n", F.lit(0)) != F.col("chunk_count"), "index.inconsistent").when(~F.col("__r").eqNullSafe(F.col("revision")), "revision.changed")
    j = j.withColumn("reason", reason)
    return j.filter("reason is null").select(*files.columns), j.filter("reason is not null").select("document_id", "reason")


def tombstone(states: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """States in which the documents are no longer served, to be written before any of their edges is touched.

    Their manifest joins the pending one, which :func:`settle` then retracts; unknown documents get a state, settled tombstones stay as they are.
    """
    gone = documents.select("tenant", "document_id").distinct().withColumn("__g", F.lit(True))
    none = F.array().cast("array<string>")
    j = states.join(gone, ["tenant", "document_id"], "full_outer")
    settled = (F.col("status") == "Tombstoned") & (F.size(F.coalesce("manifest", none)) == 0) & (F.size(F.coalesce("pending_manifest", none)) == 0)
    hit = F.col("__g").isNotNull() & ~F.coalesce(settled, F.lit(False))
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
    return j.select(
        "tenant", "document_id", put("status", F.lit("Tombstoned")),
        *(put(c, F.lit(None).cast("string")) for c in ("active_revision", "active_extraction_version", "pending_revision")),
        put("manifest", none), put("pending_manifest", F.array_union(F.coalesce("manifest", none), F.coalesce("pending_manifest", none))), put("updated_at", now),
    )


def settle(edges: DataFrame, states: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(edges with the pending ids of tombstones retracted at ``now``, states with nothing pending): the second write."""
    pending = states.filter("status = 'Tombstoned'").select(F.explode("pending_manifest").alias("assertion_id")).distinct().withColumn("__g", F.lit(True))
    j = edges.join(pending, "assertion_id", "left")
    hit = F.col("__g").isNotNull() & (F.col("status") != "Retracted")
    out = j.withColumn("retracted_at", F.when(hit, now).otherwise(F.col("retracted_at"))).withColumn("status", F.when(F.col("__g"), "Retracted").otherwise(F.col("status")))
    return out.select(*edges.columns), states.withColumn("pending_manifest", F.when(F.col("status") == "Tombstoned", F.array().cast("array<string>")).otherwise(F.col("pending_manifest")))
