"""Common neighbours by blocks: lists meet where a block of them is held, and wedges never leave their task.

Vertices are cut by id into blocks of about equal numbers of edges, and vertices by hash into slices. A task
holds the lists of one block; to it come the lists of one slice that point into the block. A list so moves once for each
slice and once for each block that it points into, however many of its edges lead there, and is packed on the
way. Tasks hold BLOCK_IDS ids, more blocks are made of larger graphs. The same way is taken for graphs of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbour ids of a block, edges for which a task is worth starting, tasks for each core.
BLOCK_IDS, TASK_EDGES, SPREAD = 32_000_000, 50_000, 4
#: Wedges, and places of the table of members, that a task looks at together.
WEDGES, PLACES = 1_000_000, 16_000_000
#: Blocks begin at some of so many quantiles of the ids.
QUANTILES = 1024


def packed(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, int, pa.Array]:
    """Ascending lists as their first ids, the bytes of a step, and steps; of an empty list the first id is 0."""
    n = np.diff(offsets)
    full = n > 0
    first = np.zeros(len(n), np.int64)
    first[full] = values[offsets[:-1][full]]
    inner = np.ones(len(values), bool)
    inner[offsets[:-1][full] - offsets[0]] = False
    steps = np.diff(values, prepend=values[:1])[inner]
    most = int(steps.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << 8 * w)
    ends = np.concatenate(([0], np.cumsum(np.maximum(n - 1, 0)))) * width
    data = pa.py_buffer(steps.astype("<i8" if width == 8 else f"<u{width}").tobytes())
    return first, width, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), data])


def unpacked(first: np.ndarray, size: np.ndarray, width: np.ndarray, steps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of packed lists one after the other, and where each list begins."""
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(start[-1]), np.int64)
    head = start[:-1][size > 0]
    inner = np.ones(len(out), bool)
    inner[head] = False
    steps = steps.cast(pa.large_binary())
    ends = np.frombuffer(steps.buffers()[1], np.int64)[steps.offset : steps.offset + len(steps) + 1]
    data = memoryview(steps.buffers()[2] or b"")
    for w in np.unique(width[size > 1]).tolist():
        kind = "<i8" if w == 8 else f"<u{w}"
        of = width == w
        if of.all():
            out[inner] = np.frombuffer(data[ends[0] : ends[-1]], kind)
        else:
            rows = np.flatnonzero(of & (size > 1)).tolist()
            out[inner & np.repeat(of, size)] = np.concatenate([np.frombuffer(data[ends[i] : ends[i + 1]], kind) for i in rows])
    out[head] = first[size > 0]
    out = np.cumsum(out)
    out -= np.repeat(out[head] - first[size > 0], size[size > 0])
    return out, start


def _lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] numbers, for all i."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


SENT = "task int, held boolean, vid long, first long, size int, width int, steps binary"


def _sent(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    """Each list to the tasks that hold its block, and to those that hold a block it points into."""
    for batch in batches:
        vid = batch.column(0).to_numpy().astype(np.int64)
        values, offsets = _lists_of(batch.column(1))
        first, width, steps = packed(values, offsets)
        size = np.diff(offsets)
        own = np.searchsorted(bounds, vid, "right")
        held = np.repeat(np.arange(len(vid)), slices)
        block = np.searchsorted(bounds, values, "right")
        owner = np.repeat(np.arange(len(vid)), size)
        fresh = np.ones(len(values), bool)
        fresh[1:] = (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])
        fresh &= size[owner] > 1
        to, lane = owner[fresh], (vid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slices
        task = np.concatenate((own[held] * slices + np.tile(np.arange(slices), len(vid)), block[fresh] * slices + lane[to]))
        rows = np.concatenate((held, to))
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            taken = steps.take(pa.array(part)).cast(pa.binary())
            columns = [pa.array(task[at : at + 10_000].astype(np.int32)), pa.array(np.arange(at, at + len(part)) < len(held)), pa.array(vid[part]), pa.array(first[part]), pa.array(size[part].astype(np.int32)), pa.array(np.full(len(part), width, np.int32)), taken]
            yield pa.RecordBatch.from_arrays(columns, ["task", "held", "vid", "first", "size", "width", "steps"])


def _unsent(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vid, ids and starts of rows of SENT, by vid."""
    table = table.sort_by("vid")
    steps = table["steps"].cast(pa.large_binary()).combine_chunks()
    steps = steps if isinstance(steps, pa.Array) else pa.concat_arrays(steps.chunks or [pa.array([], pa.large_binary())])
    first, size, width = (table[c].to_numpy().astype(np.int64) for c in ("first", "size", "width"))
    return table["vid"].to_numpy(), *unpacked(first, size, width, steps)


class Codes:
    """Small numbers for ids: places in their span if that is dense, else ranks."""

    def __init__(self, ids: np.ndarray):
        self.low = int(ids.min(initial=0)) if len(ids) else 0
        span = int(ids.max()) - self.low + 1 if len(ids) else 0
        self.ranks = None if span <= max(4 * len(ids), 1 << 20) else np.unique(ids)
        self.n = span if self.ranks is None else len(self.ranks)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Codes of ids; -1 for those that have none."""
        if self.ranks is None:
            code = ids - self.low
            code[(ids < self.low) | (code >= self.n)] = -1
            return code.astype(np.int32)
        at = np.minimum(np.searchsorted(self.ranks, ids), len(self.ranks) - 1)
        return np.where(self.ranks[at] == ids, at, -1).astype(np.int32)


def _meet(held: pa.Table, given: pa.Table) -> Iterator["Meeting"]:
    """Closed wedges of the given lists: vids, ids, starts; and the places among the ids of the middle and of the end."""
    ids, flat, start = _unsent(held)
    codes = Codes(flat)
    code = codes.of(flat)
    del flat
    size = np.diff(start)
    local = np.full(codes.n + 1, -1, np.int32)  # the last is for ids without a code
    table = np.zeros(PLACES, np.int32)
    for at in range(0, given.num_rows if len(ids) else 0, 20_000):
        vids, members, begins = _unsent(given.slice(at, 20_000))
        spot = np.minimum(np.searchsorted(ids, members), len(ids) - 1)
        n = np.where(ids[spot] == members, size[spot], 0)
        total = np.concatenate(([0], np.cumsum(n)))[begins]
        member_code = codes.of(members)
        low = 0
        while low < len(vids):
            high = min(int(np.searchsorted(total, total[low] + WEDGES, "right")) - 1, len(vids))
            high = max(high, low + 1)
            while high > low + 1 and (high - low) * int(begins[high] - begins[low]) > PLACES:
                high = (low + high) // 2
            a, b = int(begins[low]), int(begins[high])
            owner = np.repeat(np.arange(high - low, dtype=np.int64), np.diff(begins[low : high + 1]))
            mine = member_code[a:b]
            distinct = np.unique(mine[mine >= 0])
            local[distinct] = np.arange(len(distinct))
            if (high - low) * len(distinct) > len(table):
                table = np.zeros((high - low) * len(distinct), np.int32)
            has = np.flatnonzero(mine >= 0)
            entry = owner[has] * len(distinct) + local[mine[has]]
            table[entry] = has + 1
            middle = np.flatnonzero(n[a:b])
            counts = n[a:b][middle]
            end = local[code[ragged(start[spot[a:b][middle]], counts)]]
            by = np.repeat(np.arange(len(middle)), counts)
            near = np.flatnonzero(end >= 0)
            by = by[near]
            place = table[owner[middle[by]] * len(distinct) + end[near]]
            closed = np.flatnonzero(place)
            table[entry] = 0
            local[distinct] = -1
            if len(closed):
                yield vids[low:high], members[a:b], begins[low : high + 1] - a, middle[by[closed]], place[closed] - 1
            low = high


Meeting = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _runs(ends: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.append(ends, n).astype(np.int32))


CLOSED = "src long, dst long, both array<long>"


def _closed(found: Meeting) -> pa.RecordBatch:
    vids, members, begins, middle, end = found
    heads = np.flatnonzero(np.diff(middle, prepend=-1))
    owner = np.searchsorted(begins, middle[heads], "right") - 1
    both = pa.ListArray.from_arrays(_runs(heads, len(middle)), pa.array(members[end]))
    return pa.RecordBatch.from_arrays([pa.array(vids[owner]), pa.array(members[middle[heads]]), both], ["src", "dst", "both"])


NETTED = "seed long, mid array<long>, n array<int>, end array<long>"


def _netted(found: Meeting) -> pa.RecordBatch:
    vids, members, begins, middle, end = found
    heads = np.flatnonzero(np.diff(middle, prepend=-1))
    owner = np.searchsorted(begins, middle[heads], "right") - 1
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    mids = _runs(first, len(heads))
    columns = [pa.array(members[middle[heads]]), pa.array(np.diff(heads, append=len(middle)).astype(np.int32))]
    ends = pa.ListArray.from_arrays(_runs(heads[first], len(middle)), pa.array(members[end]))
    return pa.RecordBatch.from_arrays([pa.array(vids[owner[first]]), *[pa.ListArray.from_arrays(mids, c) for c in columns], ends], ["seed", "mid", "n", "end"])


def _each(batches: Iterator[pa.RecordBatch], told: Callable[[Meeting], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        tasks = np.unique(batch.column(0).to_numpy()).tolist()
        for task in tasks:
            tables.setdefault(task, []).append(batch if len(tasks) == 1 else batch.filter(pc.equal(batch.column(0), task)))
    while tables:
        table = pa.Table.from_batches(tables.pop(next(iter(tables))))
        yield from map(told, _meet(table.filter(table["held"]), table.filter(pc.invert(table["held"])).sort_by("vid")))


def layout(edges: int, cores: int) -> tuple[int, int]:
    """Blocks and slices: as few moves of a list as give all cores work and no task more than BLOCK_IDS."""
    tasks = min(SPREAD * cores, -(-edges // TASK_EDGES)) or 1
    blocks = max(-(-edges // BLOCK_IDS), math.isqrt(tasks - 1) + 1)
    return blocks, -(-tasks // blocks)


def cuts(edges: DataFrame) -> tuple[int, list[int]]:
    """The number of edges, and QUANTILES ids between which they are even by src."""
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    n, at = edges.agg(F.count("*"), F.percentile_approx("src", shares, 10 * QUANTILES)).first()
    return n, list(at or [])


def _met(edges: DataFrame, lists: DataFrame, told: Callable[[Meeting], pa.RecordBatch], schema: str) -> DataFrame:
    n, at = cuts(edges)
    blocks, slices = layout(n, edges.sparkSession.sparkContext.defaultParallelism)
    bounds = np.unique(np.array([at[len(at) * i // blocks] for i in range(1, blocks)] if at else [], np.int64))
    sent = lists.select("vid", "gt").mapInArrow(lambda it: _sent(it, bounds, slices), SENT)
    return sent.repartitionById((len(bounds) + 1) * slices, "task").mapInArrow(lambda it: _each(it, told), schema)


def closing(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """(src, dst, both): every edge whose ends have common neighbours in the lists (vid, gt) of an acyclic orientation."""
    return _met(edges, lists, _closed, CLOSED)


def nets(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """seed, mid, n, end: of each vertex with triangles its neighbours that have common ones with it.

    Of mid[i] these are the next n[i] of end. A net is one row, whatever blocks its parts come from.
    """
    parts = _met(edges, lists, _netted, NETTED).groupBy("seed").agg(F.collect_list(F.struct("mid", "n", "end")).alias("p"))
    return parts.select("seed", *[F.flatten(f"p.{c}").alias(c) for c in ("mid", "n", "end")])
