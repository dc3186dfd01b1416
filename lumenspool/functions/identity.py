"""Identifiers and digests as columns: numbered, content-derived and framed ids, canonical hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix and number of digits of each kind of id.
NAMESPACES = {
    "media": ("M", 16), "transcript": ("T", 6), "word": ("W", 6), "visual_event": ("V", 6), "frame": ("F", 6), "ocr": ("O", 6),
    "visual_analysis": ("VA", 6), "image_claim": ("IC", 6), "metadata_revision": ("MR", 6), "question": ("Q", 6),
    "metadata_sufficiency": ("MS", 6), "block": ("B", 6), "chapter": ("C", 3), "review": ("R", 6), "transformation": ("X", 6),
    "candidate": ("TC", 6), "repair": ("RP", 6), "run": ("RUN", 6),
}


def sequential(namespace: str, number: Column) -> Column:
    """Prefix and number, at least as wide as the namespace says; null below 1."""
    prefix, width = NAMESPACES[namespace]
    digits = number.cast("string")
    return F.when(number >= 1, F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))))


def media(content: Column) -> Column:
    """M and 16 hex digits of the digest; a text that is a digest already stands for itself."""
    digest = F.when(F.lower(content).rlike("^[0-9a-f]{64}$"), F.lower(content)).otherwise(F.sha2(content, 256))
    return F.concat(F.lit("M"), F.upper(F.substring(digest, 1, 16)))


def framed(*parts: Column) -> Column:
    """Digest of parts, each preceded by its length in eight bytes, so that no two lists of parts run into the same bytes."""
    frame = lambda p: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p.cast("binary"))
    return F.sha2(F.concat(*[frame(p.cast("string")) for p in parts]), 256)


def deterministic(namespace: str, *parts: Column) -> Column:
    """A numbered id derived from content: the digest's first eight bytes, modulo all numbers of the namespace's width."""
    if namespace == "media":
        return media(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    width = NAMESPACES[namespace][1]
    value = F.conv(F.substring(framed(*parts), 1, 16), 16, 10).cast("decimal(20,0)")
    return sequential(namespace, F.pmod(value, F.lit(10**width - 1).cast("decimal(20,0)")).cast("long") + 1)


def _parts(identifier: Column) -> tuple[Column, Column]:
    prefixes = "|".join(sorted((p for p, _ in NAMESPACES.values()), key=lambda p: (-len(p), p)))
    pattern = rf"^({prefixes})([0-9]+|[0-9A-F]{{16}})$"
    return F.regexp_extract(identifier, pattern, 1), F.regexp_extract(identifier, pattern, 2)


def namespace_of(identifier: Column) -> Column:
    """Namespace of a valid id: known prefix, exact width, number above 0 (16 hex digits for media); null if invalid."""
    prefix, number = _parts(identifier)
    cases = [F.when((prefix == p) & (F.length(number) == width) & (F.lit(name == "media") | (number.rlike("^[0-9]+$") & number.rlike("[1-9]"))), F.lit(name))
             for name, (p, width) in NAMESPACES.items()]
    return F.coalesce(*cases)


def is_valid(identifier: Column, namespace: str | None = None) -> Column:
    found = namespace_of(identifier)
    return F.coalesce(found == namespace, F.lit(False)) if namespace else found.isNotNull()


def number_of(identifier: Column) -> Column:
    """The number of a valid id that is not a media's."""
    return F.when(namespace_of(identifier) != "media", _parts(identifier)[1].cast("long"))


def timestamp_slug(ms: Column) -> Column:
    """hh-mm-ss-mmm for file names."""
    unit = lambda k, n, w: F.lpad(F.pmod(F.floor(ms / k), F.lit(n)).cast("string"), w, "0") if n else F.lpad(F.floor(ms / k).cast("string"), F.greatest(F.lit(w), F.length(F.floor(ms / k).cast("string"))), F.lit("0"))
    return F.concat_ws("-", unit(3_600_000, 0, 2), unit(60_000, 60, 2), unit(1000, 60, 2), unit(1, 1000, 3))


def source_id(kind: Column, ordinal: Column, start: Column, end: Column, *given: Column) -> Column:
    """A record's own id, else its kind and a digest of kind, ordinal and times."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    text = F.concat(F.lit('["'), kind, F.lit('",'), F.concat_ws(",", shown(ordinal), shown(start), shown(end)), F.lit("]"))
    return F.coalesce(*[g.cast("string") for g in given], F.concat(kind, F.lit("_"), F.substring(F.sha2(text, 256), 1, 16)))


def canonical(fields: dict[str, Column]) -> Column:
    """Compact JSON text of flat text and whole-number fields, keys sorted; the digest of it keys caches and payloads."""
    def shown(value: Column) -> Column:
        return F.coalesce(value, F.lit("null"))

    parts = [F.concat(F.lit(f'"{name}":'), shown(value)) for name, value in sorted(fields.items())]
    return F.concat(F.lit("{"), reduce(lambda a, b: F.concat(a, F.lit(","), b), parts), F.lit("}"))


def json_text(value: Column) -> Column:
    """A text as a JSON string; control characters as a JSON writer has them."""
    safe = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    shown = lambda c: F.when(F.ascii(c) < 32, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)
    safe = F.when(value.rlike(r"[\x00-\x1F]"), F.array_join(F.transform(F.split(safe, ""), shown), "")).otherwise(safe)
    return F.concat(F.lit('"'), safe, F.lit('"'))


def cache_key(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical(fields), 256)


def payload_digest(fields: dict[str, Column], digest_field: str = "digest") -> Column:
    """Digest of the fields but the digest's own."""
    return cache_key({k: v for k, v in fields.items() if k != digest_field})
