"""Operator 7: personal data, by bootstrapped contextual extraction.

Seeds are what four strict rules find (email, ip, card, phone).  Every seed, and everything else that looks like
an identifier (a token with three digits in a row, a run of digit groups with six digits, a token with an @
inside), is an instance; the two words before it, and the word before it with the word behind it, are its lexical
patterns.  Spark scores the bipartite graph of patterns and instances in turns, until no pattern is new: a pattern's
confidence for a kind is the share of its distinct instances that are of that kind, an instance's is that of
its patterns combined.  Patterns of high confidence with enough distinct seeds then mark unseen instances as
identifiers of their kind.

The texts are read twice and not shuffled: once for the graph's edges (few, and merged before the
shuffle), once to mark spans with the accepted patterns.  Those are broadcast while there are at most
``max_broadcast`` of them (counted).  Beyond that the texts' candidate spans are joined with the table of patterns by a
shuffle, and only texts with a marked span are joined with theirs; the result is the same.

Defined results: null and empty texts have no spans; ids may be null; repeated rows stay; copies of
a text count once, since pattern and instance make one edge however often they meet; of a pattern's kinds
the most confident counts, then the one with most seeds, then the first; very long texts are read whole; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, written

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What an instance contains: digit groups, three digits in a row, or an @ inside a token.
_RUN = re.compile(r"[0-9]{1,6}(?:[ .()-]{1,2}[0-9]{1,6})+|[0-9]{3,}|(?<=[A-Za-z0-9._%+-])@(?=[A-Za-z0-9])")
_THREE = re.compile(r"[0-9]{3}")
_ID_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@/")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
#: Characters of context that are looked at on either side.
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += _DOUBLED[d] if i % 2 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email rule, found from each ``@``: linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the strict rules, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of an instance; digits are folded, so that they hold no instance."""
    before = re.sub("[0-9]", "0", text[max(0, start - CONTEXT) : start].lower()).split()[-2:]
    after = re.sub("[0-9]", "0", text[end : end + CONTEXT].lower()).split()[:1]
    out = []
    if len(before) == 2:
        out.append("< " + " ".join(before))
    if before and after:
        out.append(f"<> {before[-1]} {after[0]}")
    return out


def unmarked(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What looks like an identifier and no base span touches: whole tokens, or digit groups between spaces."""
    out, last, taken = [], 0, sorted((a, b) for _, a, b in spans)
    k = 0
    for m in _RUN.finditer(text):
        if m.start() < last:
            continue
        a, b = m.span()
        while a > last and text[a - 1] in _ID_SET:
            a -= 1
        while b < len(text) and text[b] in _ID_SET:
            b += 1
        while b > m.end() and text[b - 1] in ".-/%+":
            b -= 1
        last = b
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        digits = sum(map(m[0].count, "0123456789"))
        enough = digits >= 6 or _THREE.search(m[0]) or "@" in m[0]
        if enough and b - a >= 5 and (k == len(taken) or taken[k][0] >= b):
            out.append((a, b))
    return out


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of everything that an accepted pattern would mark."""
    return [(a, b, p) for a, b in unmarked(text, base_spans(text)) for p in contexts(text, a, b)] if text else []


def all_spans(text: str | None, patterns: dict[str, int], known: list | None = None) -> tuple[list, list]:
    """Base spans, and those that accepted patterns add: by lookup, or as ``known`` (kind, start, end)."""
    if not text:
        return [], []
    base = base_spans(text)
    if known is not None:
        found: dict = {}
        for kind, a, b in known:
            found[a, b] = min(kind, found.get((a, b), kind))
        return base, [(k, a, b) for (a, b), k in found.items()]
    added = []
    if patterns:
        for a, b in unmarked(text, base):
            kinds = [patterns[p] for p in contexts(text, a, b) if p in patterns]
            if kinds:
                added.append((min(kinds), a, b))
    return base, added


def edges(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct (pattern, instance, kind): kind is null for what no rule knows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    for kind, a, b in [*base, *((None, a, b) for a, b in unmarked(text, base))]:
                        instance = hashlib.sha256(text[a:b].lower().encode()).hexdigest()[:32]
                        seen.update((p, instance, kind) for p in contexts(text, a, b))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32()))], ["pattern", "instance", "kind"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(scan, "pattern string, instance string, kind int")
    return found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def bootstrap(docs: DataFrame, text_col: str = "text", turns: int = 8, confidence: float = 0.9, seeds: float = 5.0) -> DataFrame:
    """Accepted patterns and their kinds (pattern, kind), as a written table."""
    arrow_batches(docs.sparkSession)
    graph = written(edges(docs, text_col), "pii-edges")
    totals = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    known = graph.filter("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    scores, accepted, before = known, None, -1
    for _ in range(turns):
        hits = graph.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("hits"))
        hits = hits.filter(F.col("hits") >= seeds)
        accepted = hits.join(totals, "pattern").withColumn("confidence", F.col("hits") / (F.col("total") + 0.5)).filter(F.col("confidence") >= confidence)
        accepted = written(accepted.select("pattern", "kind", "confidence", "hits"), "pii-patterns")
        now = accepted.count()
        if now == before:
            break
        before = now
        new = graph.filter("kind is null").select("pattern", "instance").join(accepted, "pattern").groupBy("instance", "kind")
        new = new.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
        scores = written(known.unionByName(new.join(known.select("instance"), "instance", "left_anti")), "pii-instances")
    best = F.min_by("kind", F.struct((-F.col("confidence")).alias("c"), (-F.col("hits")).alias("h"), "kind"))
    return written(accepted.groupBy("pattern").agg(best.alias("kind")), "pii-accepted")


def _marked(docs: DataFrame, patterns: DataFrame, text_col: str, max_broadcast: int, finish, schema) -> DataFrame:
    """mapInArrow of ``finish(batch, spans of each row)`` over the rows, whose text column is a string."""
    spark = docs.sparkSession
    arrow_batches(spark)
    columns, at = docs.columns, docs.columns.index(text_col)
    if patterns.count() <= max_broadcast:
        t = patterns.toArrow()
        shared = spark.sparkContext.broadcast(dict(zip(t.column("pattern").to_pylist(), t.column("kind").to_pylist())))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finish(batch, [all_spans(t, shared.value) for t in batch.column(at).to_pylist()])

        return docs.mapInArrow(apply, schema)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *c) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in candidates(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["__hash", "start", "end", "pattern"])

    hashed = F.sha2(F.col(text_col), 256)
    spelt = docs.select(hashed.alias("__hash"), F.col(text_col)).mapInArrow(spell, "__hash string, start long, end long, pattern string").distinct()
    spans = spelt.join(patterns, "pattern").groupBy("__hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("__spans"))

    def apply_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [[(x["kind"], x["start"], x["end"]) for x in own or []] for own in batch.column(len(columns)).to_pylist()]
            yield finish(batch.select(range(len(columns))), [all_spans(t, {}, k) for t, k in zip(batch.column(at).to_pylist(), known)])

    wide = docs.withColumn("__hash", hashed).join(spans, "__hash", "left").select(*(F.col(f"`{c}`") for c in columns), "__spans")
    return wide.mapInArrow(apply_known, schema)


def redact(docs: DataFrame, patterns: DataFrame, text_col: str = "text", max_broadcast: int = 500_000) -> DataFrame:
    """The same rows and columns, with every span replaced by its kind in brackets."""
    at = docs.columns.index(text_col)

    def clean(text: str | None, base: list, added: list) -> str | None:
        out, last = [], 0
        for a, b, kind in sorted((a, b, k) for k, a, b in base + added):
            if a >= last:
                out += [text[last:a], f"[{KINDS[kind].upper()}]"]
            last = max(last, b)
        return "".join([*out, text[last:]]) if out else text

    def finish(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array([clean(t, *own) for t, own in zip(columns[at].to_pylist(), spans)], pa.string())
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return _marked(docs, patterns, text_col, max_broadcast, finish, docs.schema)


def find(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    told = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def finish(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        rows = [(*(sum(k == kind for k, _, _ in base) for kind in range(4)), hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + added)), len(added)) for base, added in spans]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [c.split()[0] for c in schema.split(", ")])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _marked(src, patterns, "text", max_broadcast, finish, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, bootstrap(docs))
