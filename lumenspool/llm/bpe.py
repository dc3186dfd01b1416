"""Byte-level BPE by DuckDB recursive queries inside each partition.

Encoding: the distinct pieces of a slice of rows that are no token themselves become token-position
rows; a recursive query joins neighbouring positions to the merge table, picks each word's leftmost
pair of least rank and contracts it, until no word has a pair left. The merge table has every pair of
tokens whose bytes joined are a token, with that token as rank and result, as the ranks file means it.
A query takes words as long as what its rounds pile up stays within ``ROWS`` rows; the rest goes to the next.

Words over ``SHORT`` bytes are cut into pieces that are contracted by themselves. Tokens in a row are the encoding of
their bytes if and only if each two neighbours are the encoding of theirs: the first contraction across a border
would also happen if the two tokens beside it stood alone. So only the borders between pieces are looked at: where two
tokens contract otherwise together, a window around their border is contracted anew, and its own two borders are
looked at next. Windows grow with the rounds, up to the whole word, so this ends. Windows over ``SHORT`` bytes
contract, in one round, all occurrences of a token that no contraction of it can undercut (see ``safe`` below), else
the leftmost one, ``ROUNDS`` rounds at a time.

Decoding: token-position rows join the vocabulary and an ordered aggregation joins their bytes.

Defined cases: null text counts as empty and has no ids; an empty table gives an empty table;
repeated rows and extra columns do not matter (only doc_id and text are read). Special tokens do not
exist: their spelling in a text is ordinary text. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspool.llm import common
from lumenspool.llm.pretokens import PieceStore

SHORT, ROUNDS = 63, 64
#: Bytes of the pieces that long words are cut into, and on either side of a border that is contracted anew at first.
PIECE, REACH = 24, 16
#: Rows that the rounds of one query pile up at most, and neighbours whose verdict is remembered; both bound memory only.
ROWS, HELD_PAIRS = 1 << 22, 1 << 20
#: Token rows that one decoding query takes at most, unless a single document has more.
DECODE_ROWS = 1 << 20

_CONTRACT_SHORT = """
with recursive state(round, k, t) as (
  select 0, k, t from positions
  union all
  (with best as (
     select a.k // 64 as w, min(m.merged * 64 + a.k % 64) as b
     from state a join state b on b.k = a.k + 1 join merges m on m.pair = a.t * 65536 + b.t
     where a.k % 64 < 63 group by 1)
   select s.round + 1, case when s.k % 64 > b % 64 then s.k - 1 else s.k end, case when s.k % 64 = b % 64 then b // 64 else s.t end
   from state s join best on s.k // 64 = best.w where s.k % 64 <> b % 64 + 1)
), last as (select k // 64 as w, max(round) as r from state group by 1)
select s.k // 64 as w, s.t as t from state s join last l on s.k // 64 = l.w and s.round = l.r order by s.k
"""

_CONTRACT_LONG = f"""
with recursive state(round, w, p, t) as (
  select 0, w, p, t from positions
  union all
  (with pairs as (
     select a.w, a.p, m.merged from state a join state b on b.w = a.w and b.p = a.p + 1 join merges m on m.pair = a.t * 65536 + b.t),
   best as (select w, min(merged) as merged from pairs group by w),
   hits as (select p.w, p.p, p.merged, row_number() over (partition by p.w order by p.p) as n from pairs p join best b on p.w = b.w and p.merged = b.merged),
   isles as (select h.w, h.p, h.merged, h.n, row_number() over (partition by h.w, h.p - h.n order by h.p) as place from hits h),
   taken as (select i.w, i.p, i.merged from isles i join safe f on f.token = i.merged where case when f.safe then i.place % 2 = 1 else i.n = 1 end),
   marked as (
     select s.round, s.w, s.p, s.t, x.merged, y.p is not null as gone, best.w is not null as alive
     from state s join best on best.w = s.w left join taken x on x.w = s.w and x.p = s.p left join taken y on y.w = s.w and y.p = s.p - 1)
   select round + 1, w, row_number() over (partition by w order by p) - 1, coalesce(merged, t) from marked where not gone and round < {ROUNDS})
), last as (select w, max(round) as r from state group by 1)
select s.w as w, s.t as t, l.r as r from state s join last l on s.w = l.w and s.round = l.r order by s.w, s.p
"""


class DuckBpe:
    """One worker's DuckDB database with vocabulary and merge tables."""

    def __init__(self, path: str):
        import duckdb

        lines = map(bytes.split, open(path, "rb"))  # noqa: SIM115
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        db = self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        db.execute("set preserve_insertion_order = false")
        db.execute("set temp_directory = ''")  # never spills to a worker's own folder; a query beyond the limit fails
        ranks = self.ranks
        if max(ranks.values(), default=0) >= 65536:
            raise ValueError("pair keys hold ranks below 65,536 only")
        pair, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pair.append(a * 65536 + b)
                    merged.append(rank)
        self._table("merges", pair=np.array(pair, np.int64), merged=np.array(merged, np.int64))
        # A token is safe if no pair it can enter has a lower rank than itself.
        left, right, made = np.array(pair) // 65536, np.array(pair) % 65536, np.array(merged)
        undercut = np.zeros(65536, bool)
        undercut[left[made < left]] = True
        undercut[right[made < right]] = True
        self._table("safe", token=np.arange(65536), safe=~undercut)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self._table("vocabulary", id=np.array([r for _, r in tokens], np.int64), bytes=pa.array([t.decode("latin-1") for t, _ in tokens]))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.stays: dict[tuple[int, int], bool] = {}  # neighbours: whether they are the encoding of their bytes

    def _table(self, name: str, **columns) -> None:
        incoming = pa.table(columns)  # noqa: F841
        self.db.execute(f"create or replace temp table {name} as select * from incoming")

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (one match of the pattern)."""
        out: list[list[int]] = [[] for _ in words]
        short, long = [], []
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = [whole]
            else:
                (short if len(w) <= SHORT else long).append(i)
        for index, ids in ((short, self._short([words[i] for i in short])), (long, self._long([words[i] for i in long]))):
            for i, x in zip(index, ids, strict=True):
                out[i] = x
        return out

    def _short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of at most SHORT bytes. A word of n bytes piles up about n * n / 2 rows."""
        out: list[list[int]] = [[] for _ in words]
        size = np.array([len(w) for w in words], np.int64)
        rows = np.append(0, np.cumsum(size * size // 2 + 1))
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(rows, rows[i] + ROWS, "right")) - 1)
            many = size[i:j]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            self._table("positions", k=np.repeat(np.arange(j - i), many) * 64 + at, t=self.single[np.frombuffer(b"".join(words[i:j]), np.uint8)])
            self._gather(out, range(i, j), self.db.execute(_CONTRACT_SHORT).fetchnumpy())
            i = j
        return out

    def _any(self, words: list[bytes]) -> list[list[int]]:
        """Ids of windows and pairs of tokens, each contracted as one."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        wide = [i for i, w in enumerate(words) if len(w) > SHORT]
        out: list[list[int]] = [[] for _ in words]
        for index, ids in ((short, self._short([words[i] for i in short])), (wide, self._wide([words[i] for i in wide]))):
            for i, x in zip(index, ids, strict=True):
                out[i] = x
        return out

    def _split(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Those neighbours that contract otherwise together."""
        new = [p for p in pairs if p not in self.stays]
        if len(self.stays) + len(new) > HELD_PAIRS:
            self.stays.clear()
            new = list(pairs)
        for (a, b), ids in zip(new, self._any([self.bytes_of[a] + self.bytes_of[b] for a, b in new]), strict=True):
            self.stays[a, b] = ids == [a, b]
        return {p for p in pairs if not self.stays[p]}

    def _long(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words over SHORT bytes: pieces, then windows around the borders that do not hold."""
        cut = [[w[k : k + PIECE] for k in range(0, len(w), PIECE)] for w in words]
        pieces = iter(self._short([p for parts in cut for p in parts]))
        state, open_ = [], []
        for parts in cut:
            lists = [next(pieces) for _ in parts]
            state.append([t for x in lists for t in x])
            open_.append(np.cumsum([len(x) for x in lists])[:-1].tolist())
        turn = 0
        while any(open_):
            reach, turn = REACH << turn // 2, turn + 1
            bad = self._split({(ids[k - 1], ids[k]) for ids, borders in zip(state, open_, strict=True) for k in borders})
            windows, spans = [], []
            for w, (ids, borders) in enumerate(zip(state, open_, strict=True)):
                if not borders:
                    continue
                size = [len(self.bytes_of[t]) for t in ids]
                mine, last, later = [], 0, []
                for k in borders:
                    if (ids[k - 1], ids[k]) not in bad:
                        continue
                    a, b, left, right = k, k, 0, 0
                    while a > 0 and left < reach:
                        a -= 1
                        left += size[a]
                    while b < len(ids) and right < reach:
                        right += size[b]
                        b += 1
                    if a < last:
                        later.append(k)  # lies within or beside a window of this round
                    else:
                        mine.append((a, b))
                        windows.append(b"".join(self.bytes_of[t] for t in ids[a:b]))
                        last = b
                spans.append((w, mine, later))
            done = iter(self._any(windows))
            for w, mine, later in spans:
                ids, new, borders, at = state[w], [], set(), 0
                waiting = iter([*later, len(ids) + 1])
                k = next(waiting)
                for a, b in [*mine, (len(ids), len(ids))]:
                    while k < a or (k == a and a < len(ids)):  # borders outside windows keep their place among what is copied
                        borders.add(len(new) + k - at)
                        k = next(waiting)
                    new += ids[at:a]
                    if a == len(ids):
                        break
                    fresh = next(done)
                    borders |= {len(new), len(new) + len(fresh)}
                    new += fresh
                    at = b
                    while k < b:  # within the window: contracted with it
                        k = next(waiting)
                state[w], open_[w] = new, sorted(x for x in borders if 0 < x < len(new))
        return state

    def _wide(self, words: list[bytes]) -> list[list[int]]:
        """Ids of windows over SHORT bytes, one word each."""
        out: list[list[int]] = [[] for _ in words]
        state = [(i, self.single[np.frombuffer(w, np.uint8)]) for i, w in enumerate(words)]
        while state:
            size = np.array([len(t) for _, t in state])
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            self._table("positions", w=np.repeat(np.arange(len(state)), size), p=at, t=np.concatenate([t for _, t in state]))
            done = self.db.execute(_CONTRACT_LONG).fetchnumpy()
            cut = np.flatnonzero(np.diff(done["w"], prepend=-1))
            rest = []
            for w, r, t in zip(done["w"][cut], done["r"][cut], np.split(done["t"], cut[1:]), strict=True):
                if r >= ROUNDS:
                    rest.append((state[w][0], np.asarray(t)))
                else:
                    out[state[w][0]] = t.tolist()
            state = rest
        return out

    @staticmethod
    def _gather(out: list[list[int]], index, done: dict) -> None:
        cut = np.flatnonzero(np.diff(done["w"], prepend=-1))
        flat, stops = done["t"].tolist(), [*cut[1:].tolist(), len(done["t"])]
        for w, a, b in zip(done["w"][cut].tolist(), cut.tolist(), stops, strict=True):
            out[index[w]] = flat[a:b]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids."""
        out, n, i = [], len(first) - 1, 0
        while i < n:
            j = max(i + 1, min(n, int(np.searchsorted(first, first[i] + DECODE_ROWS, "right")) - 1))
            many = np.diff(first[i : j + 1])
            tokens = pa.table({"row": np.repeat(np.arange(j - i), many), "place": np.arange(first[j] - first[i]), "id": ids[first[i] : first[j]].astype(np.int64)})  # noqa: F841
            got = self.db.execute("select row, string_agg(bytes, '' order by place) as s from tokens join vocabulary using (id) group by row").fetchall()
            part = [b""] * (j - i)
            for row, s in got:
                part[row] = s.encode("latin-1")
            out += part
            i = j
        return out


_workers: dict[str, tuple[DuckBpe, PieceStore]] = {}


def worker(path: str) -> tuple[DuckBpe, PieceStore]:
    """This process's tables for a ranks file, made once."""
    if path not in _workers:
        bpe = DuckBpe(path)
        _workers[path] = bpe, PieceStore(bpe.encode)
    return _workers[path]


def encode_column(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, store = worker(path)
        for batch in common.by_text(batches):
            offsets, data = common.utf8_parts(batch.column(1))
            ids, first = store.rows(offsets, data)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))], [id_column, "ids"])

    rows = docs.select(id_column, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"{id_column} {dict(rows.dtypes)[id_column]}, ids array<int>")


def decode_column(tokens: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, bytes binary) of rows (id, ids)."""
    common.ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = worker(path)
        for batch in batches:
            lists = batch.column(1)
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64))])
            yield pa.record_batch([batch.column(0), pa.array(bpe.decode(lists.flatten().to_numpy(), first), pa.binary())], [id_column, "bytes"])

    return tokens.select(id_column, "ids").mapInArrow(run, f"{id_column} {dict(tokens.dtypes)[id_column]}, bytes binary")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, store = worker(path)
        for batch in common.by_text(batches):
            offsets, data = common.utf8_parts(batch.column(1))
            ids, first = store.rows(offsets, data)
            raw = memoryview(ids.astype("<u4").tobytes())
            cuts = (first * 4).tolist()
            yield pa.record_batch([
                batch.column(0),
                pa.array(np.diff(first)),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, first)], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
