"""Operator 1: secret scans by multipart credential linking, in DataFrame functions only.

Strong parts are what the base rules find: assigned secrets, access identifiers (both complete) and
hex strings.  Weak parts are identifiers (``client_id = ...``), endpoints (URLs) and bare mixed
tokens; alone they say nothing.  An interval join within scopes links them: a weak part is reported
only if a part of a complementary role (a secret to an identifier or endpoint, and the other way
round) starts within ``scope`` characters in the same document.

The text is read once; the parts go to a table in the shared folder.  The join is an equi-join on
(row, role, scope bin) with a range condition, and a semi join: pairs are never emitted.  A row's
parts fill many bins, so a document with very many parts is spread over tasks.

Offsets come from the pieces between matches: ``split`` gives them, ``regexp_extract_all`` the
matches, and the lengths add up.

Defined results: null text counts as empty; null ids and repeated rows stay; of spans with one start the first kind comes first; very
long texts are read whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, written

#: Base rules (fixed values): kind, pattern, group whose length counts, least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
#: Weak parts: value length and mix are checked after the match.
IDENTIFIER = r"""(?<![A-Za-z0-9])(?:client|account|access|tenant|application|app|user|key)[_-]?(?:id|name)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._-]{4,}"""
ENDPOINT = r"""(?<![A-Za-z0-9])(?:https?|wss?|s?ftp|amqps?|rediss?|mongodb|mysql|postgres(?:ql)?)://[^\x20\x09-\x0D"'<>]{4,}"""
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KIND_ORDER = (*BASE_KINDS, "identifier", "endpoint", "token")
#: Role of each kind: what it can be a part of.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "endpoint": "endpoint", "token": "secret"}
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
#: Matches of a text that are gathered together.
BLOCK = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """Spans of all leftmost matches; ``ok`` judges a match."""
    none = F.array().cast(SPAN)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["size"]).alias("end"))).cast(SPAN)
        good = x["size"].isNotNull() if ok is None else x["size"].isNotNull() & ok(x["hit"])
        return F.struct((at + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def in_blocks(steps: Column) -> Column:
        # An array grows by copying, so spans are gathered by blocks; where a block starts is a sum of the blocks before it.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
        lengths = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + F.coalesce(x["size"], F.lit(0))))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = lambda ls: F.aggregate(ls, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        each = lambda b, s: F.aggregate(b, F.struct(s.alias("at"), none.alias("out")), step, lambda a: a["out"])
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(lengths(bs)), each)))

    def placed(matches: Column) -> Column:
        return let(F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(matches, F.length).alias("size"), matches.alias("hit")), in_blocks)

    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def _long_enough(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def _mixed(match: Column) -> Column:
    return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KIND_ORDER))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, assign, access, hex, weak) for each row, written to the shared folder."""
    none = F.array().cast(SPAN)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    guard = lambda mark, spans: F.when(F.contains("text", F.lit(mark)), spans).otherwise(none)
    t = F.col("text")
    found = src.select(
        "doc_id",
        _spans(t, ASSIGN, 0, _long_enough).alias("assign"),
        guard("AKIA", _spans(t, ACCESS, 1)).alias("access"),
        _spans(t, HEX, 2).alias("hex"),
        _spans(t, IDENTIFIER, 3).alias("ident"),
        guard("://", _spans(t, ENDPOINT, 4)).alias("endpoint"),
        _spans(t, TOKEN, 5, _mixed).alias("token"),
    )
    return written(found.withColumn("rid", F.monotonically_increasing_id()), "secret-parts")


def link(found: DataFrame, scope: int = 200) -> DataFrame:
    """(rid, linked): the weak parts of each row that a complementary part confirms."""
    roles = F.create_map(*(F.lit(x) for i, k in enumerate(KIND_ORDER) for x in (i, ROLES[k])))
    wants = F.create_map(*(x for role, others in COMPLEMENTS.items() for x in (F.lit(role), F.array(*map(F.lit, others)))))
    some_weak = (F.size("ident") + F.size("endpoint") + F.size("token") > 0) & (F.size("assign") + F.size("access") + F.size("hex") + F.size("ident") + F.size("endpoint") + F.size("token") > 1)
    flat = found.filter(some_weak).select("rid", F.explode(F.concat("assign", "access", "hex", "ident", "endpoint", "token")).alias("p"))
    flat = flat.select("rid", "p.*").withColumn("role", F.element_at(roles, F.col("kind"))).withColumn("bin", F.floor(F.col("start") / scope))
    weak = flat.filter(F.col("kind") >= len(BASE_KINDS)).withColumn("want", F.explode(F.element_at(wants, F.col("role")))).alias("w")
    other = flat.select("rid", "role", F.col("start").alias("at"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).distinct().alias("o")
    near = (F.col("w.rid") == F.col("o.rid")) & (F.col("w.bin") == F.col("o.bin")) & (F.col("w.want") == F.col("o.role")) & (F.abs(F.col("w.start") - F.col("o.at")) <= scope)
    linked = weak.join(other, near, "left_semi").select("rid", F.struct("start", "kind", "end").alias("s")).distinct()
    return linked.groupBy("rid").agg(F.collect_list("s").cast(SPAN).alias("linked"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for each row."""
    found = parts(docs, id_col, text_col)
    none = F.array().cast(SPAN)
    base = F.concat("assign", "access", "hex")
    out = found.join(link(found, scope), "rid", "left").withColumn("linked", F.coalesce("linked", none)).withColumn("base", base)
    # A weak span that a base span covers adds nothing.
    fresh = F.filter("linked", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    out = out.withColumn("fresh", fresh)
    size = lambda c: F.size(c).cast("long")
    return out.select(
        "doc_id",
        size("assign").alias("n_assign"),
        size("access").alias("n_access"),
        size("hex").alias("n_hex"),
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(F.concat("base", "fresh")).alias("spans"),
        size("fresh").alias("n_linked"),
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
