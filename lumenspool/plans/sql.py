"""What SQL users of a session can call: the data source, scalar functions and lateral table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenspool.functions import alignment as L
from lumenspool.sources import json_records

#: SQL functions: name and parameters, type, body.
SCALARS = (
    ("overlap_ms(a_start BIGINT, a_end BIGINT, b_start BIGINT, b_end BIGINT)", "BIGINT", "greatest(0L, least(a_end, b_end) - greatest(a_start, b_start))"),
    ("clock(ms BIGINT)", "STRING", "format_string('%02d:%02d:%02d.%03d', ms div 3600000, (ms div 60000) % 60, (ms div 1000) % 60, ms % 1000)"),
    ("perceptual_distance(a BIGINT, b BIGINT)", "INT", "bit_count(a ^ b)"),
)


@F.udtf(returnType="place int, tag string, a_start int, a_end int, b_start int, b_end int")
class AlignTokens:
    """Opcodes between two arrays of tokens, a row each: ``select .. from pairs, lateral align_tokens(a, b)``."""

    def eval(self, a: list, b: list) -> Iterator[tuple]:
        a, b = a or [], b or []
        numbers: dict = {}
        codes = np.array([numbers.setdefault(t, len(numbers)) for t in [*a, *b]], np.int64)
        first = [np.array([0, len(x)]) for x in (a, b)]
        found = L.matching_blocks(codes[: len(a)], first[0], codes[len(a) :], first[1])
        for place, (_, tag, *ends) in enumerate(zip(*[x.tolist() for x in L.opcodes(1, first[0][1:], first[1][1:], *found)], strict=True)):
            yield (place, L.TAGS[tag], *ends)


def register(spark: SparkSession) -> None:
    """Makes all of them known to a session; calling it again changes nothing."""
    json_records.register(spark)
    spark.udtf.register("align_tokens", AlignTokens)
    for signature, kind, body in SCALARS:
        spark.sql(f"create or replace temporary function {signature} returns {kind} return {body}")
