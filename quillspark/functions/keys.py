"""Keys, hashes and normal forms; JVM expressions wherever Spark has them."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import _TO_SPACE, units

_DASHES = "–—"
_SINGLE = "‘’"
_DOUBLE = "“”"


def base64url(data: Column) -> Column:
    """Unpadded base64url of a string or binary column."""
    return F.translate(F.rtrim(F.regexp_replace(F.base64(data), r"[\r\n]", ""), F.lit("=")), "+/", "-_")


def chunk_key(drive: Column, item: Column, number: Column) -> Column:
    return base64url(F.encode(F.concat_ws(":", drive, item, number.cast("string")), "UTF-8"))


def sha256_base64(text: Column) -> Column:
    return F.base64(F.unhex(F.sha2(text, 256)))


def permissions_hash(anonymous: Column, principals: Column, roles: Column) -> Column:
    """Order-free digest of a permission snapshot."""
    line = lambda a: F.array_join(F.array_sort(F.coalesce(a, F.array().cast("array<string>"))), "\n")
    flag = F.when(anonymous, F.lit("1")).otherwise(F.lit("0"))
    return sha256_base64(F.concat(flag, F.lit("\n"), line(principals), F.lit("\n\n"), line(roles)))


def fingerprint(**settings: object) -> Column:
    return F.lit(";".join(f"{k}={v}" for k, v in settings.items()))


def normal_name(value: str | None) -> str | None:
    """NFKC, white space collapsed, each character lower-cased by itself."""
    if value is None:
        return None
    folded = " ".join(w for w in unicodedata.normalize("NFKC", value).translate(_TO_SPACE).split(" ") if w)
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in folded)


def normal_predicate(value: str | None) -> str | None:
    """NFKC words in capitals, joined by underscores."""
    if value is None:
        return None
    text = unicodedata.normalize("NFKC", value)
    for c in "\t\r\n-_":
        text = text.replace(c, " ")
    return "".join(c.upper() if len(c.upper()) == 1 else c for c in "_".join(w for w in text.split(" ") if w))


def fold(value: str | None) -> str | None:
    """Straight quotes and dashes, then the normal name."""
    if value is None:
        return None
    return normal_name(value.translate({**{ord(c): "-" for c in _DASHES}, **{ord(c): "'" for c in _SINGLE}, **{ord(c): '"' for c in _DOUBLE}}))


def id_hash(*parts: str) -> str:
    """First 16 bytes in hex of SHA-256 over parts, each led by its length in UTF-16 units."""
    return hashlib.sha256("".join(f"{units(p)}:{p};" for p in parts).encode()).hexdigest()[:32]


#: First part of what is hashed (fixed values).
ENTITY_SCHEME, ASSERTION_SCHEME = "graph-entity/v1", "graph-assertion/v1"


def entity_id(tenant: str, kind: str, key: str) -> str:
    return f"{kind.lower()}:{id_hash(ENTITY_SCHEME, tenant, kind, key)}"


def assertion_id(tenant: str, document: str, version: str, chunk: str, subject: str, predicate: str, object_: str, symmetric: bool = False) -> str:
    """Symmetric relations have one id for both directions."""
    if symmetric and object_ < subject:
        subject, object_ = object_, subject
    return "assertion:" + id_hash(ASSERTION_SCHEME, tenant, document, version, chunk, subject, predicate, object_)


def _batch(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def apply(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return apply


def normalize_name(c: Column) -> Column:
    """Spark has no Unicode normal forms and lower-cases words, not characters: an Arrow function."""
    return _batch(normal_name)(c)


def normalize_predicate(c: Column) -> Column:
    return _batch(normal_predicate)(c)


def fold_text(c: Column) -> Column:
    return _batch(fold)(c)


def name_key(c: Column) -> Column:
    return F.concat(F.lit("name:"), normalize_name(c))


def identifier_key(scheme: Column, value: Column) -> Column:
    normal = _batch(lambda v: unicodedata.normalize("NFKC", v).strip())(value)
    return F.when(scheme.rlike("^[a-z0-9-]+$"), F.concat_ws(":", F.lit("id"), scheme, normal))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def hashed_id(*parts: Column) -> Column:
    """id_hash in the JVM."""
    return F.substring(F.sha2(F.concat(*(x for p in parts for x in (utf16_length(p).cast("string"), F.lit(":"), p, F.lit(";")))), 256), 1, 32)


def entity_id_column(tenant: Column, kind: Column, key: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), hashed_id(F.lit(ENTITY_SCHEME), tenant, kind, key))


def assertion_id_column(tenant: Column, document: Column, version: Column, chunk: Column, subject: Column, predicate: Column, object_: Column, symmetric: Column) -> Column:
    a = F.when(symmetric, F.least(subject, object_)).otherwise(subject)
    b = F.when(symmetric, F.greatest(subject, object_)).otherwise(object_)
    return F.concat(F.lit("assertion:"), hashed_id(F.lit(ASSERTION_SCHEME), tenant, document, version, chunk, a, predicate, b))


def document_id(drive: Column, item: Column) -> Column:
    return F.concat_ws(":", drive, item)


def document_parts(doc: Column) -> Column:
    """struct(drive, item), null unless there are exactly two parts that are not empty."""
    p = F.split(doc, ":")
    ok = (F.size(p) == 2) & (F.length(p[0]) > 0) & (F.length(p[1]) > 0)
    return F.when(ok, F.struct(p[0].alias("drive"), p[1].alias("item")))


def revision_id(ctag: Column, etag: Column, index_fingerprint: Column) -> Column:
    tag = F.coalesce(F.nullif(F.trim(ctag), F.lit("")), F.nullif(F.trim(etag), F.lit("")))
    return F.when(tag.isNotNull() & (F.length(F.trim(index_fingerprint)) > 0), F.concat(F.lit("rev:"), hashed_id(tag, index_fingerprint)))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def is_content_hash(c: Column) -> Column:
    return c.rlike("^sha256:[0-9a-f]{64}$")


def access_scope(permissions: Column) -> Column:
    return F.when(F.length(F.trim(permissions)) > 0, F.concat(F.lit("perm:"), F.translate(F.rtrim(permissions, F.lit("=")), "+/", "-_")))


def extraction_version(prompt: str, model: str, ontology: str) -> str:
    return f"{prompt}.{ontology}.{id_hash(prompt, model, ontology)[:8]}"


def partition_bucket(tenant: Column, anchor: Column, buckets: int) -> Column:
    """``tenant|0000``: the little-endian first four bytes of the anchor's SHA-256, modulo buckets."""
    h = F.sha2(anchor, 256)
    swapped = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    return F.concat(tenant, F.lit("|"), F.lpad((F.conv(swapped, 16, 10).cast("long") % buckets).cast("string"), 4, "0"))


def storage_safe(c: Column) -> Column:
    """Not blank, up to 255 characters, no white space around, no control characters and none of / \\ ? #."""
    return F.coalesce((utf16_length(c) <= 255) & c.rlike(r"^(?U)[^\s\p{Cntrl}/\\?#](?:[^\p{Cntrl}/\\?#]*[^\s\p{Cntrl}/\\?#])?$"), F.lit(False))


def blob_segment(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "-")


def principal_tokens(kind: Column, ident: Column, email: Column) -> Column:
    """``kind:id`` and ``email:`` in lower case, as far as known."""
    return F.array_compact(F.array(F.when(F.length(ident) > 0, F.concat_ws(":", kind, ident)), F.when(F.length(email) > 0, F.concat(F.lit("email:"), F.lower(email)))))


def client_state(name: str, secret: str) -> str:
    """Signed state of a subscription."""
    body = f"spas1.{name}"
    return f"{body}.{hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()}"


def verify_client_state(c: Column, secret: str) -> Column:
    def ok(state: str) -> bool:
        name = state.removeprefix("spas1.").rpartition(".")[0]
        return hmac.compare_digest(state.encode(), client_state(name, secret).encode())

    return F.coalesce(_batch(ok, "boolean")(c), F.lit(False))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM").cast("int")


def next_month(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month.cast("string"), F.lit("01")), "yyyyMMdd"), 1), "yyyyMM").cast("int")


def day_text(day: Column) -> Column:
    """20240131 as 2024-01-31."""
    return F.format_string("%04d-%02d-%02d", (day / 10000).cast("int"), ((day / 100).cast("int") % 100).cast("int"), (day % 100).cast("int"))
