"""Best partners of every report, found inside cells of time.

Partners are at most a span of days apart, so a cell of one or more spans, with the reports of one span on either side, holds all partners of
its reports. Spark sends each report to its cell and to the neighbours that it borders on, one shuffle for all combinations of signals; a task then
sorts the reports of its cell by (combination, time), the largest combinations first, and keeps the best of each report that still lacks partners.
A pair is taken from the combination of all that it shares, so it is met once. Link ids are hashed for ties of the last place alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reports that a cell should hold, and the most (with its borders) that a task takes at a time.
CELL_ROWS, MOST_ROWS = 150_000, 600_000

#: Reports of one record that the search steps over; the reports of larger records are looked up by keys.
MOST_REPORTS = 32

#: Pairs compared at a time.
CHUNK = 2_000_000

_FAR = np.iinfo(np.int64).max
_OUT = "id string, other string, shared long, gap_seconds long, across boolean"


def cell_width(reports: int, first: int, last: int, span: int) -> int:
    """Seconds of a cell: one to eight spans, by how dense the reports are."""
    return span * int(max(1, min(8, (last - first + 1) / span * CELL_ROWS / max(reports, 1))))


def celled(base: DataFrame, width: int, span: int) -> DataFrame:
    """Reports with ``cell``, in their own cell and, ``border``, in those whose reports may reach them."""
    own = F.floor(F.col("second") / width)
    into = F.col("second") - own * width
    cells = F.array_compact(F.array(F.struct(own.alias("cell"), F.lit(False).alias("border")), F.when(into < span, F.struct((own - 1).alias("cell"), F.lit(True).alias("border"))), F.when(width - into <= span, F.struct((own + 1).alias("cell"), F.lit(True).alias("border")))))
    return base.select("id", "record", "second", "marks", "many", F.explode(cells).alias("c")).select("c.cell", "c.border", "id", "record", "second", "marks", "many")


def _links(ids: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits of the link ids of pairs, in their order; numbers of reports are in the order of their ids."""
    sha, pairs = hashlib.sha256, zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)
    return np.frombuffer(b"".join([sha(ids[i] + b"|" + ids[j]).digest()[:8] for i, j in pairs]), dtype=">u8").astype(np.uint64)


def _best(ids: list[bytes], a: np.ndarray, b: np.ndarray, gap: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs of each asking report the ``need[report]`` with the least gap; ties go to the least link id."""
    order = np.lexsort((gap, a))
    a, b, gap = a[order], b[order], gap[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[first, a.size])
    want = need[a[first]]
    last = gap[first + np.minimum(size, want) - 1]
    limit, full = np.repeat(last, size), np.repeat(size > want, size)
    tied = full & (gap == limit)
    link = np.zeros(a.size, dtype=np.uint64)
    link[tied] = _links(ids, a[tied], b[tied])
    keep = np.flatnonzero(gap <= limit)
    a, b, gap, link = a[keep], b[keep], gap[keep], link[keep]
    order = np.lexsort((link, gap, a))
    a, b, gap = a[order], b[order], gap[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    place = np.arange(a.size) - np.repeat(first, np.diff(np.r_[first, a.size]))
    keep = place < need[a]
    return a[keep], b[keep], gap[keep]


def _entries(marks: np.ndarray, size: np.ndarray, asks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(key, report)`` for every combination of ``n`` signals that an asking report has; keys are small numbers."""
    keys, rows = [], []
    for chosen in combinations(range(marks.shape[1]), n):
        at = np.flatnonzero(size > chosen[-1])
        key = np.full(at.size, n, dtype=np.uint64)
        for c in chosen:
            key = (key ^ marks[at, c]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        keys.append(key)
        rows.append(at)
    key, row = np.concatenate(keys), np.concatenate(rows)
    asked = np.unique(key[asks[row]])
    place = np.minimum(np.searchsorted(asked, key), max(asked.size - 1, 0))
    held = asked[place] == key if asked.size else np.zeros(key.size, dtype=bool)
    return place[held], row[held]


def _partners_of(ids: list[bytes], record: np.ndarray, second: np.ndarray, marks: np.ndarray, codes: np.ndarray, size: np.ndarray, asks: np.ndarray, need: np.ndarray, n: int, pairs: int, span: int, many: int) -> tuple[np.ndarray, ...] | None:
    """The best pairs of the asking reports that share exactly ``n`` signals: ``(asking, other, gap)``."""
    key, row = _entries(marks, size, asks, n)
    if key.size < 2:
        return None
    # keys lie further apart than a span, so a span never reaches into the next key
    at = key * (int(second.max() - second.min()) + 2 * span + 2) + (second[row] - second.min())
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    ask = np.flatnonzero(asks[row])
    apart = np.diff(at) > span
    ask = ask[~(np.r_[True, apart][ask] & np.r_[apart, True][ask])]
    found = []

    def meet(e: np.ndarray, low: np.ndarray, count: np.ndarray) -> None:
        a = np.repeat(row[e], count)
        b = row[np.arange(a.size) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        other = record[a] != record[b]
        a, b = a[other], b[other]
        left, right = [c[a] for c in codes], [c[b] for c in codes]
        shared = np.zeros(a.size, dtype=np.int8)
        for x in left:
            for y in right:
                shared += (x == y) & (x >= 0)
        exact = shared == n
        a, b = a[exact], b[exact]
        if a.size:
            found.append(_best(ids, a, b, np.abs(second[a] - second[b]), need))

    side = pairs + many - 1
    for e in np.array_split(ask, max(1, -(-ask.size * side // CHUNK))):
        if not e.size:
            continue
        gaps = np.full((e.size, 2 * side), span, dtype=np.int64)
        for k in range(1, side + 1):
            for column, there in ((2 * k - 2, e - k), (2 * k - 1, e + k)):
                inside = (there >= 0) & (there < at.size)
                there = np.where(inside, there, 0)
                fine = inside & (record[row[there]] != record[row[e]])
                gaps[:, column] = np.where(fine, np.minimum(np.abs(at[there] - at[e]), span), span)
        reach = np.partition(gaps, pairs - 1, axis=1)[:, pairs - 1]
        low, high = np.searchsorted(at, at[e] - reach, "left"), np.searchsorted(at, at[e] + reach, "right")
        count = high - low
        begin = 0
        for end in [*np.flatnonzero(np.diff(np.cumsum(count) // CHUNK)) + 1, e.size]:
            meet(e[begin:end], low[begin:end], count[begin:end])
            begin = end
    if not found:
        return None
    return _best(ids, *(np.concatenate(part) for part in zip(*found, strict=True)), need)


def _search(table: pa.Table, pairs: int, span: int) -> pa.Table:
    """The best pairs of a cell's own reports; a pair of two own reports once."""
    table = table.combine_chunks().sort_by("id")
    n = table.num_rows
    column = lambda name: table.column(name).combine_chunks()
    code = lambda name: column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ids, record, second = column("id").cast(pa.binary()).to_pylist(), code("record"), column("second").to_numpy()
    lists = column("marks")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    begin, width = np.cumsum(size) - size, max(int(size.max()), 1)
    marks, codes = np.zeros((n, width), dtype=np.uint64), np.full((width, n), -1, dtype=np.int32)
    known = np.unique(flat, return_inverse=True)[1]
    for i in range(width):
        has = size > i
        marks[has, i], codes[i, has] = flat[begin[has] + i].view(np.uint64), known[begin[has] + i]
    many = column("many").to_numpy()
    own = ~column("border").to_numpy(zero_copy_only=False)
    asks = own & (many <= MOST_REPORTS)
    need = np.full(n, pairs)
    rows = []
    for shared in range(width, 0, -1):
        active = asks & (need > 0)
        if not active.any():
            break
        got = _partners_of(ids, record, second, marks, codes, size, active, need, shared, pairs, span, int(many[active].max()))
        if got:
            a, b, gap = got
            need = need - np.bincount(a, minlength=n)
            rows.append((a, b, np.full(a.size, shared), gap))
    if not rows:
        return pa.table({"id": pa.array([], pa.string()), "other": pa.array([], pa.string()), "shared": pa.array([], pa.int64()), "gap_seconds": pa.array([], pa.int64()), "across": pa.array([], pa.bool_())})
    a, b, shared, gap = (np.concatenate(part) for part in zip(*rows, strict=True))
    inner = own[b]
    once = np.unique(np.where(inner, np.minimum(a, b) * n + np.maximum(a, b), a * n + b), return_index=True)[1]
    a, b, shared, gap, inner = a[once], b[once], shared[once], gap[once], inner[once]
    names = column("id")
    return pa.table({"id": names.take(pa.array(a)), "other": names.take(pa.array(b)), "shared": pa.array(shared, pa.int64()), "gap_seconds": pa.array(gap, pa.int64()), "across": pa.array(~inner)})


def best_in_cells(cells: DataFrame, *, pairs: int, span: int) -> DataFrame:
    """``id, other, shared, gap_seconds, across`` of :func:`celled` reports; a pair ``across`` two cells may come twice."""

    def search(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(pa.Table.from_batches(list(group)), pairs, span).to_batches()

    return cells.groupBy("cell").applyInArrow(search, _OUT)
