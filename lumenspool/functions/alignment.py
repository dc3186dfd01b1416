"""Ordered comparison of token lists by longest matching blocks (Ratcliff-Obershelp), over whole batches at once.

The longest run of equal tokens (the earliest in the first list, then in the second) parts both lists; what lies before
and after is compared in the same way. Rows are aligned together, round by round: all places where two lists hold the
same token are points of one array, each in the span that it still belongs to; a round finds the longest diagonal run of
every span, keeps the points that lie wholly before or after it and gives them new spans. Nothing loops over rows or
tokens, and a round costs what points are left. Rows are taken in slices of at most POINTS points. A pair of lists that
has more by itself is first parted by row sweeps, which hold one row of run lengths, until its spans have fewer.

Defined cases: null lists count as empty and null tokens equal one another; two empty lists have ratio 1; very long
lists take time in proportion to the product of their lengths over a vector's width but bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most points (pairs of equal tokens) that are held at once.
POINTS = 1 << 21
TAGS = ("equal", "replace", "delete", "insert")
OPCODE = "struct<tag: string, a_start: int, a_end: int, b_start: int, b_end: int>"
_OPCODE = pa.struct([("tag", pa.string()), ("a_start", pa.int32()), ("a_end", pa.int32()), ("b_start", pa.int32()), ("b_end", pa.int32())])


def _points(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a[i] == b[j]."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = high - low
    i = np.repeat(np.arange(len(a)), count)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    return i, j


def _n_points(a: np.ndarray, b: np.ndarray) -> int:
    order = np.sort(b)
    return int((np.searchsorted(order, a, "right") - np.searchsorted(order, a, "left")).sum())


def _chain(span: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs that are the longest of their spans, sorted by (span, i, j): each span's first, then the first wholly after that, and so on."""
    found = []
    while len(span):
        head = np.flatnonzero(np.append(True, span[1:] != span[:-1]))
        found.append((span[head], i[head], j[head], size[head]))
        of = np.repeat(head, np.diff(np.append(head, len(span))))
        keep = (i >= i[of] + size[of]) & (j >= j[of] + size[of])
        span, i, j, size = span[keep], i[keep], j[keep], size[keep]
    out = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def _blocks(span: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching blocks (i, j, length) of the points of many spans; i and j tell the row, so spans need not be kept.

    What lies before a span's earliest longest run has shorter runs only, and what lies after it has none longer, so
    equally long runs of a span are taken in one round.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.lexsort((i, i - j))
    span, i, j = span[order], i[order], j[order]
    wide = int(i.max(initial=0)) + 2
    while len(span):
        used = np.flatnonzero(np.bincount(span))  # spans that have points are numbered anew
        number = np.empty(span.max() + 1, np.int64)
        number[used] = np.arange(len(used))
        span = number[span]
        new = np.append(True, (span[1:] != span[:-1]) | (i[1:] - i[:-1] != 1) | (j[1:] - j[:-1] != 1))
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, len(span)))
        rs = span[starts]
        most = np.zeros(len(used), np.int64)
        by_span = np.argsort(rs, kind="stable")
        most[:] = np.maximum.reduceat(length[by_span], np.searchsorted(rs[by_span], np.arange(len(used))))
        longest = starts[length == most[rs]]
        longest = longest[np.lexsort((j[longest], i[longest], span[longest]))]
        ps, pi, pj, pn = _chain(span[longest], i[longest], j[longest], most[span[longest]])
        found.append((pi, pj, pn))
        # Where each point lies among its span's picks: behind ``at - 1`` and before ``at``.
        at = np.searchsorted(ps * wide + pi + pn, span * wide + i, "right")
        first, last = np.searchsorted(ps, span, "left"), np.searchsorted(ps, span, "right")
        nxt, prev = np.minimum(at, len(ps) - 1), np.maximum(at - 1, 0)
        keep = ((at == last) | ((i < pi[nxt]) & (j < pj[nxt]))) & ((at == first) | (j >= pj[prev] + pn[prev]))
        span, i, j = (at + span)[keep], i[keep], j[keep]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The longest block of two lists by a sweep over the first, holding one row of run lengths."""
    best, run = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
    for i, token in enumerate(a):
        nxt = np.zeros_like(run)
        same = np.flatnonzero(b == token)
        nxt[same + 1] = run[same] + 1
        if len(same) and (size := int(nxt.max())) > best[0]:
            best = (size, i - size + 1, int(nxt.argmax()) - size)
        run = nxt
    return best[1], best[2], best[0]


def _part(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of one pair of lists whose points are more than ``most``."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        if lo == hi or low == high:
            continue
        if _n_points(a[lo:hi], b[low:high]) <= most:
            i, j = _points(a[lo:hi], b[low:high])
            x, y, n = _blocks(np.zeros(len(i), np.int64), i, j)
            yield x + lo, y + low, n
            continue
        i, j, n = _longest(a[lo:hi], b[low:high])
        if n:
            yield np.array([lo + i]), np.array([low + j]), np.array([n])
            todo += [(lo, lo + i, low, low + j), (lo + i + n, hi, low + j + n, high)]


def matching_blocks(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, most: int = POINTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j, length) of maximal matching blocks of many pairs of lists, in order, i and j counted within the row's lists.

    a, b: token numbers of all rows; row r has a[a_first[r]:a_first[r + 1]] and b[b_first[r]:b_first[r + 1]].
    """
    rows, n = [], len(a_first) - 1
    row_a, row_b = np.repeat(np.arange(n), np.diff(a_first)), np.repeat(np.arange(n), np.diff(b_first))
    top = int(max(a.max(initial=0), b.max(initial=0))) + 1
    key_a, key_b = row_a * top + a, row_b * top + b  # equal only within a row
    order = np.sort(key_b)
    count = np.searchsorted(order, key_a, "right") - np.searchsorted(order, key_a, "left")
    total = np.append(0, np.cumsum(count))[a_first]  # points before each row
    r = 0
    while r < n:
        end = max(r + 1, int(np.searchsorted(total, total[r] + most, "right")) - 1)
        x, y = slice(a_first[r], a_first[end]), slice(b_first[r], b_first[end])
        if end == r + 1 and total[end] - total[r] > most:
            parts = list(_part(a[x], b[y], most))
            i, j, size = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        else:
            i, j = _points(key_a[x], key_b[y])
            i, j, size = _blocks(row_a[x][i] if len(i) else i, i, j)
        row = row_a[x][i] if len(i) else i
        rows.append((row, i + a_first[r] - a_first[row], j + b_first[r] - b_first[row], size))
        r = end
    row, i, j, size = (np.concatenate(p) for p in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((i, row))
    row, i, j, size = row[order], i[order], j[order], size[order]
    if not len(row):
        return row, i, j, size
    new = np.append(True, (row[1:] != row[:-1]) | (i[:-1] + size[:-1] != i[1:]) | (j[:-1] + size[:-1] != j[1:]))
    starts = np.flatnonzero(new)  # blocks that touch are one
    return row[starts], i[starts], j[starts], np.add.reduceat(size, starts)


def opcodes(n: int, a_size: np.ndarray, b_size: np.ndarray, row: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, tag number, a_start, a_end, b_start, b_end) that turn the first lists into the second, in order."""
    every = np.append(row, np.arange(n))  # a closing block of no length for each row
    i, j, size = np.append(i, a_size), np.append(j, b_size), np.append(size, np.zeros(n, np.int64))
    order = np.lexsort((np.append(np.zeros(len(row)), np.ones(n)), i, every))
    row, i, j, size = every[order], i[order], j[order], size[order]
    first = np.append(True, row[1:] != row[:-1])
    left, right = np.where(first, 0, np.append(0, (i + size)[:-1])), np.where(first, 0, np.append(0, (j + size)[:-1]))
    gap = np.where((i > left) & (j > right), 1, np.where(i > left, 2, np.where(j > right, 3, -1)))
    out = [np.column_stack(x).reshape(-1) for x in ((row, row), (gap, np.where(size > 0, 0, -1)), (left, i), (i, i + size), (right, j), (j, j + size))]
    keep = out[1] >= 0
    return tuple(x[keep] for x in out)


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all rows, first) of a list column; null lists are empty."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return column.flatten(), np.append(0, np.cumsum(size))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, column = batch.num_rows, lambda name, b=batch: b.column(b.schema.get_field_index(name))
        if not n:
            continue
        (a, a_first), (b, b_first) = _lists(column("_a")), _lists(column("_b"))
        codes = pa.concat_arrays([a, b]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row, i, j, size = matching_blocks(codes[: len(a)], a_first, codes[len(a) :], b_first)
        a_size, b_size = np.diff(a_first), np.diff(b_first)
        matched = np.bincount(row, weights=size, minlength=n).astype(np.int64)
        every = a_size + b_size
        ratio = np.where(every > 0, 2.0 * matched / np.maximum(every, 1), 1.0)
        at, tag, *ends = opcodes(n, a_size, b_size, row, i, j, size)
        names = pa.DictionaryArray.from_arrays(pa.array(tag, pa.int8()), pa.array(TAGS)).cast(pa.string())
        ops = pa.StructArray.from_arrays([names, *[pa.array(e, pa.int32()) for e in ends]], fields=list(_OPCODE))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32()), ops)
        own = [batch.column(k) for k, name in enumerate(batch.schema.names) if name not in ("_a", "_b")]
        yield pa.record_batch([*own, pa.array(a_size, pa.int64()), pa.array(b_size, pa.int64()), pa.array(matched), pa.array(ratio), lists],
                              names=[x for x in batch.schema.names if x not in ("_a", "_b")] + ["a_count", "b_count", "matched", "ratio", "opcodes"])


def align(df: DataFrame, before: Column, after: Column, keep: list[str]) -> DataFrame:
    """keep's columns of df with a_count, b_count, matched, ratio (2 x matched over both counts) and opcodes of two columns of token lists."""
    kinds = dict(df.dtypes)
    rows = df.select(*keep, before.alias("_a"), after.alias("_b"))
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "a_count bigint, b_count bigint, matched bigint, ratio double", f"opcodes array<{OPCODE}>"])
    return rows.mapInArrow(_align, schema)


def changed_tokens(opcodes: Column, tokens: Column, side: str) -> Column:
    """Tokens that only one list has, in order: side a (missing from the second) or b (added)."""
    tags = ("delete", "replace") if side == "a" else ("insert", "replace")
    mine = F.filter(opcodes, lambda o: o["tag"].isin(*tags))
    return F.flatten(F.transform(mine, lambda o: F.slice(tokens, o[f"{side}_start"] + 1, o[f"{side}_end"] - o[f"{side}_start"])))


def substitutions(opcodes: Column, a: Column, b: Column) -> Column:
    """Pairs (a, b) of tokens that took each other's place, as far as both sides of a replacement go."""
    def pairs(o: Column) -> Column:
        n = F.least(o["a_end"] - o["a_start"], o["b_end"] - o["b_start"])
        return F.zip_with(F.slice(a, o["a_start"] + 1, n), F.slice(b, o["b_start"] + 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))

    return F.flatten(F.transform(F.filter(opcodes, lambda o: o["tag"] == "replace"), pairs))


def audit_ordered(df: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """Ordered audit of token lists a (source) and b (output): align's columns, faithful, reordered, missing, added and substitutions."""
    carried = [*keep, a, b]
    rows = align(df, F.col(a), F.col(b), carried)
    empty = F.array().cast("array<string>")
    x, y = F.coalesce(F.col(a), empty), F.coalesce(F.col(b), empty)
    return rows.withColumns({
        "faithful": x == y, "reordered": (x != y) & (F.array_sort(x) == F.array_sort(y)),
        "missing": changed_tokens(F.col("opcodes"), x, "a"), "added": changed_tokens(F.col("opcodes"), y, "b"), "substitutions": substitutions(F.col("opcodes"), x, y),
    }).drop(a, b)
