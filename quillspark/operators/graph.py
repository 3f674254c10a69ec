"""Knowledge graph: grounding, resolution, linking, bounded traversal, verification and state changes.

Entities (entity_id, entity_type, canonical_name, aliases, redirect_to), edges (assertion_id, subject_id,
predicate, object_id, status, document_id, document_version, chunk_id, chunk_hash) and document states
(document_id, status, active_revision) are tables; each operator is a join plan over them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    predicate: str
    subjects: tuple[str, ...]
    objects: tuple[str, ...]
    symmetric: bool = False
    antisymmetric: bool = False
    same_type: bool = False


@dataclass(frozen=True)
class Ontology:
    version: str
    types: tuple[str, ...]
    relations: tuple[Relation, ...]
    attributes: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def symmetric(self) -> list[str]:
        return [r.predicate for r in self.relations if r.symmetric]

    def errors(self) -> list[str]:
        """What is wrong with the definition, each with where."""
        out = [] if re.fullmatch(r"[A-Za-z0-9._-]{1,64}", self.version) else ["version: 1 to 64 letters, digits, '.', '_' or '-'"]
        out += [] if self.types else ["types: at least one is needed"]
        for i, t in enumerate(self.types):
            out += [] if re.fullmatch(r"[A-Z][A-Za-z0-9]{0,63}", t) else [f"types[{i}]: bad name {t}"]
            out += [f"types[{i}]: duplicate type {t}"] if t in self.types[:i] else []
        for t, names in self.attributes:
            out += [] if t in self.types else [f"attributes: unknown type {t}"]
            out += [f"attributes of {t}: bad key {n}" for n in names if not re.fullmatch(r"[a-z][A-Za-z0-9]{0,63}", n)]
            out += [f"attributes of {t}: duplicate key {n}" for n in {n for n in names if names.count(n) > 1}]
        seen = set()
        for i, r in enumerate(self.relations):
            at = f"relations[{i}]"
            out += [] if re.fullmatch(r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)*", r.predicate) and len(r.predicate) <= 64 else [f"{at}: bad predicate {r.predicate}"]
            out += [f"{at}: duplicate predicate {r.predicate}"] if r.predicate in seen else []
            seen.add(r.predicate)
            for side in (r.subjects, r.objects):
                out += [] if side else [f"{at}: a side without types"]
                out += [f"{at}: unknown type {t}" for t in side if t not in self.types]
            out += [f"{at}: a symmetric relation has the same types on both sides"] if r.symmetric and set(r.subjects) != set(r.objects) else []
            out += [f"{at}: symmetric and antisymmetric"] if r.symmetric and r.antisymmetric else []
            out += [f"{at}: one type on both ends, but no type is on both"] if r.same_type and not set(r.subjects) & set(r.objects) else []
        return out

    def allows(self, subject_type: Column, predicate: Column, object_type: Column) -> Column:
        """The triple rule, as one expression: the relations are few and known to the plan."""
        rules = (
            (predicate == r.predicate) & subject_type.isin(*r.subjects) & object_type.isin(*r.objects) & (F.lit(True) if not r.same_type else subject_type == object_type)
            for r in self.relations
        )
        return F.coalesce(reduce(lambda a, b: a | b, rules, F.lit(False)), F.lit(False))


_DOCUMENTS = ("Policy", "Requirement", "Contract")
#: The default ontology (fixed values).
DEFAULT = Ontology(
    "v1",
    ("System", "Project", "Team", "Person", "Policy", "Requirement", "Contract", "BusinessProcess"),
    (
        Relation("DEPENDS_ON", ("System", "Project", "BusinessProcess"), ("System",)),
        Relation("INTEGRATES_WITH", ("System",), ("System",), symmetric=True),
        Relation("OWNED_BY", ("System", "Project", "Policy", "Contract", "BusinessProcess"), ("Team", "Person")),
        Relation("IMPLEMENTS", ("System", "Project", "BusinessProcess"), ("Requirement", "Policy")),
        Relation("SUPERSEDES", _DOCUMENTS, _DOCUMENTS, antisymmetric=True, same_type=True),
        Relation("APPLIES_TO", _DOCUMENTS, ("System", "Project", "Team", "BusinessProcess")),
    ),
    (("System", ("vendor",)), ("Project", ("projectCode",)), ("Policy", ("policyNumber",)), ("Requirement", ("requirementNumber",)), ("Contract", ("contractNumber",))),
)


def canonical(ids: DataFrame, column: str, entities: DataFrame, hops: int = 5) -> DataFrame:
    """``column`` follows redirects, up to ``hops`` of them: unrolled left joins."""
    moves = entities.filter(F.col("redirect_to").isNotNull()).select(F.col("entity_id").alias("__from"), F.col("redirect_to").alias("__to"))
    for _ in range(hops):
        ids = ids.join(moves, ids[column] == moves["__from"], "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")
    return ids


def link_phrases(phrases: DataFrame, aliases: DataFrame) -> DataFrame:
    """(phrase) to (phrase, entity_id, ambiguous): exact aliases; a phrase with several entities links to none."""
    found = phrases.join(aliases.select(F.col("alias").alias("phrase"), "entity_id"), "phrase")
    per = found.groupBy("phrase").agg(F.count_distinct("entity_id").alias("k"), F.min("entity_id").alias("e"))
    return per.select("phrase", F.when(F.col("k") == 1, F.col("e")).alias("entity_id"), (F.col("k") > 1).alias("ambiguous"))


def resolve(mentions: DataFrame, aliases: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """(mention_id, entity_type, alias, identifier_entity) to decisions.

    An identifier decides first, and its mention's alias then serves the rest of the batch; else exactly one
    entity of the type with that alias is taken, none makes a new one, and several are ambiguous.
    """
    live = canonical(aliases.select("entity_type", "alias", "entity_id"), "entity_id", entities)
    batch = mentions.filter(F.col("identifier_entity").isNotNull()).select("entity_type", "alias", F.col("identifier_entity").alias("entity_id"))
    known = live.unionByName(batch).distinct()
    found = known.groupBy("entity_type", "alias").agg(F.array_sort(F.collect_set("entity_id")).alias("c"))
    joined = mentions.join(found, ["entity_type", "alias"], "left")
    k = F.coalesce(F.size("c"), F.lit(0))
    decision = F.when(F.col("identifier_entity").isNotNull(), "identifier").when(k == 1, "alias").when(k <= 0, "new").otherwise("ambiguous")
    return joined.select("mention_id", decision.alias("decision"), F.coalesce("identifier_entity", F.when(k == 1, F.col("c")[0])).alias("entity_id"), F.when(k > 1, F.slice("c", 1, most)).alias("candidates"))


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def build_entities(candidates: DataFrame, most_aliases: int = 20) -> DataFrame:
    """(entity_id, position, entity_type, name, alias): first name and type, first distinct aliases."""
    one = candidates.groupBy("entity_id").agg(F.min_by("entity_type", "position").alias("entity_type"), F.min_by("name", "position").alias("canonical_name"))
    a = candidates.groupBy("entity_id", "alias").agg(F.min("position").alias("p"))
    a = a.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("p", "alias"))).filter(F.col("n") <= most_aliases)
    a = a.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return one.join(a, "entity_id", "left")


def mark_contradictions(edges: DataFrame, ontology: Ontology = DEFAULT) -> DataFrame:
    """Antisymmetric edges whose reverse is present become Disputed."""
    anti = [r.predicate for r in ontology.relations if r.antisymmetric]
    back = edges.filter(F.col("predicate").isin(*anti)).select(F.col("object_id").alias("subject_id"), "predicate", F.col("subject_id").alias("object_id"), F.lit(True).alias("__b")).distinct()
    return edges.join(back, ["subject_id", "predicate", "object_id"], "left").withColumn("status", F.when(F.col("__b"), "Disputed").otherwise(F.col("status"))).select(*edges.columns)


def serving(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Edges of documents that are ready, in the active revision."""
    ready = states.filter("status = 'Ready'").select("document_id", F.col("active_revision").alias("document_version"))
    return edges.join(ready, ["document_id", "document_version"], "left_semi")


def adjacent(edges: DataFrame, frontier: DataFrame, direction: str, symmetric: list[str]) -> DataFrame:
    """Edges at (id, owner) rows with the end they leave from and the other end: two equi joins, never an OR."""
    is_sym = F.col("predicate").isin(*symmetric) if symmetric else F.lit(False)
    f = frontier.select(F.col("id").alias("__id"), F.col("owner").alias("from_id"))
    out = edges.filter(is_sym | F.lit(direction != "in")).join(f, F.col("subject_id") == F.col("__id")).select(*edges.columns, "from_id", F.col("object_id").alias("other"), F.lit(0).alias("__side"))
    back = edges.filter(is_sym | F.lit(direction != "out")).join(f, F.col("object_id") == F.col("__id")).select(*edges.columns, "from_id", F.col("subject_id").alias("other"), F.lit(1).alias("__side"))
    return first_by(out.unionByName(back), ["assertion_id"], ["__side", "from_id"]).drop("__side")


def adjacency_page(edges: DataFrame, ids: DataFrame, direction: str, most: int, ontology: Ontology = DEFAULT) -> tuple[DataFrame, bool]:
    """(the first ``most`` adjacent edges in order of their ids, whether there are more): one more is asked for than is returned."""
    own = ids.select("id", F.col("id").alias("owner"))
    page = adjacent(edges.filter("status <> 'Retracted'"), own, direction, ontology.symmetric).orderBy("assertion_id").limit(most + 1)
    return page.orderBy("assertion_id").limit(most), page.count() > most


@dataclass
class Traversal:
    starts: list[str]
    edges: list = field(default_factory=list)
    visited: int = 0
    truncated: str | None = None


def traverse(edges: DataFrame, states: DataFrame, entities: DataFrame, starts: list[str], predicates: list[str], direction: str = "both", max_depth: int = 2, max_entities: int = 50, max_assertions: int = 200, ontology: Ontology = DEFAULT) -> Traversal:
    """Breadth-first search within bounds.

    Per level: one adjacency plan, serving filter and redirects in Spark; new entities are admitted in the
    order of their first edge while there is room, and edges in the order of their ids.  What comes to
    the driver is at most the bounds (1,000 entities, 5,000 edges).
    """
    if not (1 <= max_depth <= 3 and 1 <= max_entities <= 1000 and 1 <= max_assertions <= 5000) or direction not in ("in", "out", "both"):
        raise ValueError("depth 1-3, entities 1-1000, assertions 1-5000, direction in, out or both")
    spark = edges.sparkSession
    live = serving(edges.filter((F.col("status") != "Retracted") & F.col("predicate").isin(*predicates)), states)
    ids = lambda xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "id string, n int")
    # Redirects are followed once; each level then needs one join.
    merged = canonical(entities.filter(F.col("redirect_to").isNotNull()).select("entity_id", F.col("entity_id").alias("owner")), "owner", entities).persist()
    owner_of = lambda df, c: df.join(merged.select(F.col("entity_id").alias(c), F.col("owner").alias("__o")), c, "left").withColumn(c, F.coalesce("__o", c)).drop("__o")
    order = [r["id"] for r in owner_of(ids(starts), "id").orderBy("n").collect()]
    out = Traversal(list(dict.fromkeys(order))[:max_entities])
    visited, seen, frontier = set(out.starts), set(), out.starts
    for depth in range(1, max_depth + 1):
        if not frontier or out.truncated:
            break
        own = ids(frontier).select("id", F.col("id").alias("owner"))
        owners = own.unionByName(merged.join(own.select("owner"), "owner", "left_semi").select(F.col("entity_id").alias("id"), "owner"))
        found = adjacent(live, F.broadcast(owners), direction, ontology.symmetric)
        found = owner_of(found, "other").filter("other <> from_id")
        if seen:
            found = found.join(F.broadcast(ids(sorted(seen)).select(F.col("id").alias("assertion_id"))), "assertion_id", "left_anti")
        room = max_entities - len(visited)
        new = found.join(F.broadcast(ids(sorted(visited)).select(F.col("id").alias("other"))), "other", "left_anti")
        admitted = [r["other"] for r in new.groupBy("other").agg(F.min("assertion_id").alias("a")).orderBy("a", "other").limit(room + 1).collect()]
        over, admitted = len(admitted) > room, admitted[:room]
        keep = ids(sorted(visited | set(admitted))).select(F.col("id").alias("other"))
        rest = max_assertions - len(out.edges)
        rows = found.join(F.broadcast(keep), "other", "left_semi").orderBy("assertion_id").limit(rest + 1).collect()
        if len(rows) > rest:
            out.truncated, rows = "assertions", rows[:rest]
        elif over:
            out.truncated = "entities"
        frontier = []
        for r in rows:
            seen.add(r["assertion_id"])
            out.edges.append((r["assertion_id"], depth, r["from_id"], r["other"]))
            if r["other"] not in visited:
                visited.add(r["other"])
                frontier.append(r["other"])
    out.visited = len(visited)
    merged.unpersist()
    return out


def traverse_many(edges: DataFrame, states: DataFrame, entities: DataFrame, starts: DataFrame, predicates: list[str], direction: str = "both", max_depth: int = 2, max_entities: int = 50, max_assertions: int = 200, ontology: Ontology = DEFAULT, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`traverse` for all questions at once: ((question, assertion_id, depth, from_id, to_id), (question, visited, assertions, truncated)).

    starts: (question, id, n), the starts of each question in order of ``n``.  Frontier, visited entities, seen assertions and budgets are
    rows with their question; admission within the budgets is a window over one question's candidates of a level.  ``keep`` writes a
    table and reads it back (by default to the session's checkpoint folder), so each level's plan begins at tables; the driver gets nothing but counts.
    """
    if not (1 <= max_depth <= 3 and 1 <= max_entities <= 1000 and 1 <= max_assertions <= 5000) or direction not in ("in", "out", "both"):
        raise ValueError("depth 1-3, entities 1-1000, assertions 1-5000, direction in, out or both")
    keep = keep or _kept
    live = serving(edges.filter((F.col("status") != "Retracted") & F.col("predicate").isin(*predicates)), states).select("assertion_id", "subject_id", "predicate", "object_id")
    live = keep(live, "live")
    merged = keep(canonical(entities.filter(F.col("redirect_to").isNotNull()).select("entity_id", F.col("entity_id").alias("owner")), "owner", entities), "owners")
    owner_of = lambda df, c: df.join(merged.select(F.col("entity_id").alias(c), F.col("owner").alias("__o")), c, "left").withColumn(c, F.coalesce("__o", c)).drop("__o")
    rank = lambda order: F.row_number().over(Window.partitionBy("question").orderBy(*order))
    first = owner_of(starts.select("question", "id", "n"), "id").groupBy("question", "id").agg(F.min("n").alias("n"))
    visited = keep(first.withColumn("__r", rank(["n", "id"])).filter(F.col("__r") <= max_entities).select("question", "id"), "visited0")
    frontier, done, ended = visited, None, None
    symmetric = F.col("predicate").isin(*ontology.symmetric) if ontology.symmetric else F.lit(False)
    for depth in range(1, max_depth + 1):
        ends = frontier.select("question", F.col("id").alias("from_id"), "id")
        ends = ends.unionByName(merged.select(F.col("entity_id").alias("id"), F.col("owner").alias("from_id")).join(frontier.select("question", F.col("id").alias("from_id")), "from_id").select("question", "from_id", "id"))
        out = live.filter(symmetric | F.lit(direction != "in")).join(ends, F.col("subject_id") == F.col("id")).select("question", "assertion_id", "from_id", F.col("object_id").alias("other"), F.lit(0).alias("__side"))
        back = live.filter(symmetric | F.lit(direction != "out")).join(ends, F.col("object_id") == F.col("id")).select("question", "assertion_id", "from_id", F.col("subject_id").alias("other"), F.lit(1).alias("__side"))
        # The end that an edge is left by: the first side, then the least id.
        found = out.unionByName(back).groupBy("question", "assertion_id").agg(F.min(F.struct("__side", "from_id", "other")).alias("e")).select("question", "assertion_id", "e.from_id", "e.other")
        found = owner_of(found, "other").filter("other <> from_id")
        if done is not None:
            found = found.join(done.select("question", "assertion_id"), ["question", "assertion_id"], "left_anti")
        found = keep(found, f"found{depth}")
        room = visited.groupBy("question").agg((F.lit(max_entities) - F.count(F.lit(1))).alias("room"))
        new = found.join(visited.select("question", F.col("id").alias("other")), ["question", "other"], "left_anti").groupBy("question", "other").agg(F.min("assertion_id").alias("a"))
        ranked = keep(new.withColumn("__r", rank(["a", "other"])).join(room, "question"), f"new{depth}")
        over = ranked.filter(F.col("__r") > F.col("room")).select("question").distinct()
        inside = visited.select("question", F.col("id").alias("other")).unionByName(ranked.filter(F.col("__r") <= F.col("room")).select("question", "other"))
        taken = found.join(inside, ["question", "other"], "left_semi").withColumn("__r", rank(["assertion_id"]))
        rest = F.lit(max_assertions)
        if done is not None:
            used = done.groupBy("question").agg(F.count(F.lit(1)).alias("used"))
            taken, rest = taken.join(used, "question", "left"), rest - F.coalesce("used", F.lit(0))
        taken = keep(taken.withColumn("__full", F.col("__r") > rest).filter(F.col("__r") <= rest + 1), f"taken{depth}")
        full = taken.filter("__full").select("question").distinct()
        rows = taken.filter("NOT __full").select("question", "assertion_id", F.lit(depth).cast("long").alias("depth"), "from_id", F.col("other").alias("to_id"))
        stop = full.withColumn("truncated", F.lit("assertions")).unionByName(over.join(full, "question", "left_anti").withColumn("truncated", F.lit("entities")))
        ended = stop if ended is None else ended.unionByName(stop)
        done = rows if done is None else done.unionByName(rows)
        reached = keep(rows.select("question", F.col("to_id").alias("id")).distinct().join(visited, ["question", "id"], "left_anti"), f"reached{depth}")
        visited = visited.unionByName(reached)
        frontier = reached.join(stop, "question", "left_anti")
        if reached.isEmpty():
            break
    told = visited.groupBy("question").agg(F.count(F.lit(1)).alias("visited"))
    counts = done.groupBy("question").agg(F.count(F.lit(1)).alias("assertions"))
    status = told.join(counts, "question", "left").join(ended, "question", "left")
    return done, status.select("question", "visited", F.coalesce("assertions", F.lit(0)).alias("assertions"), "truncated")


def _kept(df: DataFrame, name: str) -> DataFrame:
    from ..storage.files import scratch

    path = scratch(df.sparkSession, "traversal-" + name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def verify(edges: DataFrame, revisions: DataFrame, chunks: DataFrame, tenant: str, most_documents: int = 40) -> DataFrame:
    """Each edge with why it is rejected, null if its evidence holds.

    In order: tenant, document budget, current revision, a chunk the reader may see (``chunks`` has only
    those), and the chunk's document and content hash.
    """
    e = first_by(edges, ["assertion_id"], ["position"])
    mine = e.filter(F.col("tenant") == tenant)
    first = mine.groupBy("document_id").agg(F.min("position").alias("p"))
    considered = first.orderBy("p").limit(most_documents).select("document_id", F.lit(True).alias("considered"))
    r = revisions.select("document_id", "revision")
    c = chunks.select("chunk_id", F.col("document_id").alias("chunk_document"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), F.lit(True).alias("visible")).dropDuplicates(["chunk_id"])
    j = e.join(considered, "document_id", "left").join(r, "document_id", "left").join(c, "chunk_id", "left")
    reason = (
        F.when(~F.col("tenant").eqNullSafe(F.lit(tenant)), "tenant")
        .when(F.col("considered").isNull(), "budget")
        .when(F.col("revision").isNull() | (F.col("revision") != F.col("document_version")), "revision")
        .when(F.col("visible").isNull(), "unauthorized")
        .when((F.col("chunk_document") != F.col("document_id")) | (F.col("hash") != F.col("chunk_hash")), "content")
    )
    return j.select("assertion_id", reason.alias("reason"))


def reachable(edges: DataFrame, starts: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Authorized edges (assertion_id, depth, from_id, to_id) that are still connected to the starts through authorized edges alone.

    With a ``question`` in ``starts``, the edges of each question, which are those with its ``question`` if they have one, else all.  Turns go
    on until none reaches anything new, so a way round a hidden edge counts however long it is; each turn's new entities are a table.
    """
    keep = keep or _kept
    own = ["question"] if "question" in starts.columns else []
    by = [*(c for c in own if c in edges.columns), "from_id"]
    ways = keep(edges.select(*by, F.col("to_id").alias("__to")).distinct(), "ways")
    known = frontier = keep(starts.select(*own, F.col("id").alias("from_id")).distinct(), "reached")
    while not frontier.isEmpty():
        step = frontier.join(ways, by).select(*own, F.col("__to").alias("from_id")).distinct()
        frontier = keep(step.join(known, [*own, "from_id"], "left_anti"), "reached")
        known = known.unionByName(frontier)
    out = edges.join(known, by).select(*own, *(c for c in edges.columns if c not in own))
    return out.orderBy(*own, "depth", "assertion_id")


def apply_snapshot(edges: DataFrame, old_manifest: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the fresh ones, superseded ids): what the old manifest has and the new one doesn't."""
    gone = old_manifest.select("assertion_id").join(fresh.select("assertion_id"), "assertion_id", "left_anti").distinct()
    kept = edges.join(fresh.select("assertion_id"), "assertion_id", "left_anti").unionByName(fresh)
    return retract(kept, gone), gone


def retract(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges in ``gone`` become Retracted; ids that are not there change nothing."""
    g = gone.select("assertion_id", F.lit(True).alias("__g")).distinct()
    return edges.join(g, "assertion_id", "left").withColumn("status", F.when(F.col("__g"), "Retracted").otherwise(F.col("status"))).select(*edges.columns)


def expired(edges: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Edges without those retracted for longer than the retention."""
    old = (F.col("status") == "Retracted") & (F.col("retracted_at") < now - F.make_interval(days=F.lit(days)))
    return edges.filter(~F.coalesce(old, F.lit(False)))


def same_types(a: Column, b: Column) -> Column:
    """Whether two lists of types are one set, as both sides of a symmetric relation must be."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def merge_entity(stored: DataFrame, incoming: DataFrame, most_aliases: int = 50) -> DataFrame:
    """Stored entities with incoming aliases added; names stay, new ids are inserted."""
    j = stored.alias("s").join(incoming.alias("i"), "entity_id", "full_outer")
    union = F.slice(F.array_union(F.coalesce("s.aliases", F.array().cast("array<string>")), F.coalesce("i.aliases", F.array().cast("array<string>"))), 1, most_aliases)
    return j.select("entity_id", F.coalesce("s.canonical_name", "i.canonical_name").alias("canonical_name"), union.alias("aliases"))


def reconcile(files: DataFrame, states: DataFrame, version: str, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(repairs with reasons, orphaned states), each up to ``most`` a cycle."""
    from .indexing import repair_reason

    j = files.join(states, "document_id", "left")
    reason = repair_reason(F.col("status"), F.col("active_revision"), F.col("active_version"), F.col("revision"), version, F.col("pending_revision"))
    repairs = j.select("document_id", reason.alias("reason")).filter("reason is not null").orderBy("document_id").limit(most)
    orphans = states.join(files.select("document_id"), "document_id", "left_anti").select("document_id").orderBy("document_id").limit(most)
    return repairs, orphans
