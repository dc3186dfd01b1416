"""Composed forms and character references as Arrow UDFs: Spark has no built-in for either. Batches that need nothing pass as they are."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """Canonical composition (NFC). Arrow's own function decomposes, so texts that are not composed yet go through Python's."""
    if pc.all(pc.fill_null(pc.string_is_ascii(text), True)).as_py():
        return text
    return pa.array([t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def unescaped(text: pa.Array) -> pa.Array:
    """All named and numbered character references of HTML decoded once."""
    found = pc.fill_null(pc.match_substring(text, "&"), False)
    if not pc.any(found).as_py():
        return text
    return pa.array([html.unescape(t) if t is not None and "&" in t else t for t in text.to_pylist()], pa.string())
