"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are shuffled by a keyed hash and cut into blocks. Block j (from 0) of a
source with weight w may be released at slot floor(j / w) and is due by slot ceil((j + 1) / w); in
each slot the released block with the earliest deadline goes next. With weights that add up to one
every block meets its deadline, so at any slot a source's blocks differ from w times the slots by
less than one block.

Weights are exact fractions: as whole units the schedule repeats after their sum, so of each phase at
most one period, or fewer slots if the blocks end sooner, is simulated on the driver, and every other
block's slot is arithmetic. More than MAX_SLOTS simulated slots are an error: weights are never
rounded. When a source has no blocks left its weight falls to the others in proportion: a new phase
begins with the sources that remain. There are at most as many phases as sources. So every row stays, once.

Sources are the keys of ``weights``; documents of any other source (or none) form the source "*",
of weight ``other``. What reaches the driver is one count a source; ranks within a source are
counted in buckets of the hash, of BUCKET_ROWS rows at most (about), so a source with a third of all
rows is dealt to many tasks once it has more rows than that.

Defined cases: a null source or one without a weight belongs to "*"; a null doc_id or text is kept;
repeated rows are rows of their own (equal keys may swap places); an empty table gives no rows;
other columns, whatever their names, are ignored by :func:`schedule` and kept by :func:`mix`.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, not_above, read, text_of, unpacked, whole

BLOCK_DOCS, SEED = 64, 42
#: Bounds of what the driver holds: sources, and slots simulated over all phases.
MAX_SOURCES, MAX_SLOTS = 1000, 1_000_000
REST = "*"
#: Rows of a bucket in which ranks are counted.
BUCKET_ROWS = 4_000
#: Borders (a source's first hash in each output partition, 24 bytes) that are broadcast at most.
BROADCAST_BORDERS = 1_000_000


def slots_of(units: dict[str, int]) -> Iterator[str]:
    """The source of each slot by earliest deadline first, without end.

    Ties of deadlines go to the block with the earlier next deadline, then by name.
    """
    total = sum(units.values())

    def entry(source: str, j: int) -> tuple[int, int, str, int]:
        u = units[source]
        return -(-(j + 1) * total // u), -(-(j + 2) * total // u), source, j

    released = [entry(s, 0) for s in units]
    heapq.heapify(released)
    later: list[tuple[int, tuple[int, int, str, int]]] = []
    slot = 0
    while True:
        while later and later[0][0] <= slot:
            heapq.heappush(released, heapq.heappop(later)[1])
        _, _, source, j = heapq.heappop(released)
        yield source
        heapq.heappush(later, ((j + 1) * total // units[source], entry(source, j + 1)))
        slot += 1


def period(units: dict[str, int], slots: int | None = None, have: dict[str, int] | None = None, most: int = MAX_SLOTS) -> list[str]:
    """The sources of the first slots of the schedule (all of one period if None).

    Stops before the slot for which a source is chosen that has no block left in ``have``.
    """
    left = dict(have) if have is not None else None
    order: list[str] = []
    for source in slots_of(units):
        if len(order) == (sum(units.values()) if slots is None else slots):
            break
        if left is not None:
            if left[source] <= 0:
                break
            left[source] -= 1
        if len(order) >= most:
            raise ValueError(f"these weights repeat only after more than {most} slots: use weights with a smaller common denominator")
        order.append(source)
    return order


def phases(units: dict[str, int], blocks: dict[str, int], most: int = MAX_SLOTS) -> list[dict]:
    """Pieces of the schedule: source, first block, blocks a period, periods, first slot, period, offsets."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used, slot, pieces = dict.fromkeys(left, 0), 0, []

    def put(order: list[str], times: int) -> None:
        nonlocal slot, most
        offsets: dict[str, list[int]] = {}
        for i, s in enumerate(order):
            offsets.setdefault(s, []).append(i)
        for source, own in sorted(offsets.items()):
            pieces.append({"source": source, "first": used[source], "each": len(own), "periods": times, "slot": slot, "length": len(order), "offsets": own})
            used[source] += len(own) * times
            left[source] -= len(own) * times
        slot += times * len(order)
        most -= len(order)

    while left:
        now = {s: units[s] for s in sorted(left)}
        common = math.gcd(*now.values())
        now = {s: u // common for s, u in now.items()}
        periods = min(left[s] // now[s] for s in now)
        if periods:
            put(period(now, most=most), periods)
        broken = period(now, have=left, most=most)  # the last, broken period of the phase
        if broken:
            put(broken, 1)
        left = {s: n for s, n in left.items() if n > 0}
    return pieces


def whole_units(weights: dict[str, float]) -> dict[str, int]:
    """Integer weights in exactly the proportions given (a float as it is written in decimals)."""
    if not weights or len(weights) > MAX_SOURCES or min(weights.values()) <= 0:
        raise ValueError(f"1 to {MAX_SOURCES} positive weights are needed")
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in parts.values()))
    units = {s: int(w * scale) for s, w in parts.items()}
    common = math.gcd(*units.values())
    return {s: u // common for s, u in units.items()}


def _number(text: Column) -> Column:
    """60 bits of a text's MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _keys(seed: int) -> dict[str, Column]:
    """_twin (names the text) and _hash (the place in the source's shuffle) from doc_id and text."""
    twin = _number(text_of("text").cast("binary"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), twin.cast("string"))
    return {"_twin": twin, "_hash": _number(key)}


def _ranked(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Adds _rank, from 0 within each _source, by (_hash, doc_id, _twin)."""
    # The hash's upper bits are the bucket: buckets of one source are about equal and in order.
    table = [(s, max(1, -(-n // BUCKET_ROWS))) for s, n in counts.items()]
    many = F.create_map(*[F.lit(x) for pair in table for x in pair])
    bucket = F.shiftright(F.shiftright("_hash", 29) * F.element_at(many, F.col("_source")).cast("long"), 31)
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "_twin")) - 1
    out = rows.withColumn("_in", rank).join(offsets, (F.col("_source") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return out.withColumn("_rank", F.col("_in") + F.col("_offset")).drop("_bucket", "_in", "_s", "_b", "_offset")


@dataclass(frozen=True)
class _Plan:
    """A source's rows are those of its name, or all rows of unnamed sources."""

    named: list[str]
    counts: dict[str, int]
    pieces: list[dict]
    block_docs: int

    def source(self) -> Column:
        return F.when(F.col("source").isin(self.named), F.col("source")).otherwise(F.lit(REST))

    def placed(self, ranked: DataFrame) -> DataFrame:
        """Adds block, slot and position from _source and _rank."""
        # At most two pieces a source and phase, and MAX_SLOTS offsets in all.
        table = ranked.sparkSession.createDataFrame(
            [(p["source"], p["first"], p["first"] + p["each"] * p["periods"], p["each"], p["slot"], p["length"], p["offsets"]) for p in self.pieces],
            "_p_source string, _p_first long, _p_end long, _p_each long, _p_slot long, _p_length long, _p_offsets array<int>",
        )
        rows = ranked.withColumn("block", F.call_function("div", F.col("_rank"), F.lit(self.block_docs).cast("long")))
        j = F.col("block") - F.col("_p_first")
        on = (F.col("_source") == F.col("_p_source")) & (F.col("block") >= F.col("_p_first")) & (F.col("block") < F.col("_p_end"))
        slot = F.col("_p_slot") + F.call_function("div", j, F.col("_p_each")) * F.col("_p_length") + F.get("_p_offsets", (j % F.col("_p_each")).cast("int"))
        rows = rows.join(F.broadcast(table), on).withColumn("slot", slot)
        # Only a source's last block can be short: how many rows it lacks shifts the slots after it.
        short = [(_slot_of(self.pieces, s, n // self.block_docs), self.block_docs - n % self.block_docs) for s, n in self.counts.items() if n % self.block_docs]
        position = F.col("slot") * self.block_docs + F.col("_rank") % self.block_docs
        for at, lack in sorted(short):
            position = position - F.when(F.col("slot") > at, lack).otherwise(0)
        return rows.withColumn("position", position).drop(*[c for c in table.columns])


def _planned(docs: DataFrame, weights: dict[str, float], other: float | None, block_docs: int, seed: int) -> tuple[_Plan, DataFrame]:
    """The plan, and the slim rows: doc_id, source, _source, _twin, _hash."""
    named = _Plan(list(weights), {}, [], block_docs)
    rows = docs.select("doc_id", "source", named.source().alias("_source"), *[c.alias(n) for n, c in _keys(seed).items()])
    rows = materialise(rows, "mix-rows")
    counts = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count("*").alias("n")).collect()}  # at most MAX_SOURCES + 1
    if not counts:
        return named, rows
    units = whole_units({**weights, REST: other if other is not None else min(weights.values())} if REST in counts else weights)
    return _Plan(list(weights), counts, phases(units, {s: -(-n // block_docs) for s, n in counts.items()}), block_docs), rows


def schedule(docs: DataFrame, weights: dict[str, float], other: float | None = None, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """doc_id, source, block, slot and position (gapless from 0 over all rows) of every row."""
    plan, rows = _planned(docs, weights, other, block_docs, seed)
    if not plan.counts:
        return rows.select("doc_id", "source", *[F.lit(0).cast("long").alias(c) for c in ("block", "slot", "position")])
    return plan.placed(_ranked(rows, plan.counts)).select("doc_id", "source", "block", "slot", "position")


def _slot_of(pieces: list[dict], source: str, block: int) -> int:
    for p in pieces:
        j = block - p["first"]
        if p["source"] == source and 0 <= j < p["each"] * p["periods"]:
            return p["slot"] + j // p["each"] * p["length"] + p["offsets"][j % p["each"]]
    raise ValueError("no such block")


def mix(docs: DataFrame, weights: dict[str, float], other: float | None = None, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """All rows of docs in the order of the mix: written files, read in order, are the mixed stream.

    Whole rows move once. A source's positions grow with the hash, so an output partition, which is a
    range of positions, is a range of hashes in each source; the slim rows give these borders and the
    ranks at which they lie, and ranks inside are counted where the rows arrive. Rows of one source with
    equal hashes (repeated rows) stay in one partition, at its end if they reach beyond it.
    """
    plan, rows = _planned(docs, weights, other, block_docs, seed)
    total = sum(plan.counts.values())
    if not total:
        return docs
    parts = max(1, min(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spots = plan.placed(_ranked(rows, plan.counts)).groupBy("_source", "_hash").agg(F.min("_rank").alias("_rank"), F.min("position").alias("position"))
    spots = spots.withColumn("_part", F.call_function("div", F.col("position") * parts, F.lit(total).cast("long")).cast("int"))
    borders = spots.groupBy("_source", "_part").agg(F.min("_hash").alias("_first"), F.min("_rank").alias("_rank"))
    borders = materialise(borders, "mix-borders")
    listed = borders.groupBy(F.col("_source").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_first", "_part", "_rank"))).alias("_b"))
    listed = listed.select("_of", F.transform("_b", lambda b: b["_first"]).alias("_firsts"), F.transform("_b", lambda b: F.struct(b["_part"].alias("part"), b["_rank"].alias("rank"))).alias("_ranks"))
    if borders.count() <= BROADCAST_BORDERS:
        listed = F.broadcast(listed)
    whole_rows = docs.select(whole(docs), plan.source().alias("_source"), "doc_id", *[c.alias(n) for n, c in _keys(seed).items()])
    met = whole_rows.join(listed, F.col("_source") == F.col("_of"))
    at = not_above(F.col("_firsts"), F.col("_hash"), F.size("_firsts"), parts) - 1
    met = met.select("_row", "_source", "doc_id", "_twin", "_hash", F.get("_ranks", at).alias("_at"))
    dealt = met.select("_row", "_source", "doc_id", "_twin", "_hash", F.col("_at.part").alias("_part"), F.col("_at.rank").alias("_from")).repartitionById(parts, F.col("_part"))
    inside = F.row_number().over(Window.partitionBy("_part", "_source").orderBy("_hash", "doc_id", "_twin")) - 1
    ranked = dealt.withColumn("_rank", F.col("_from") + inside)
    return unpacked(plan.placed(ranked).sortWithinPartitions("position"), docs)


#: Target weights of the query and the pipeline: sources by name; all others together have OTHER.
WEIGHTS = {f"src{i}": 1 + i % 3 for i in range(20)}
OTHER = 4


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(read(spark, sf_dir, "documents"), WEIGHTS, OTHER)


def _oracle() -> str:
    """Earliest deadline first, slot by slot: a recursion over lists with a place for each source."""
    weights = ", ".join(f"('{s}', {w})" for s, w in [*WEIGHTS.items(), (REST, OTHER)])

    def pick(units: str, done: str, at: str) -> str:
        total = f"list_sum({units})::BIGINT"
        due = f"(({done}[i] + {{}}) * {total} + {units}[i] - 1) // {units}[i]"
        return f"""list_min(list_transform(list_filter(range(1, len(u) + 1), lambda i: {units}[i] > 0 AND {done}[i] * {total} // greatest({units}[i], 1) <= {at}),
      lambda i: {{'due': {due.format(1)}, 'later': {due.format(2)}, 'i': i}})).i"""

    return f"""
WITH RECURSIVE w(source, unit) AS (VALUES {weights}),
d AS (SELECT doc_id, source AS own, CASE WHEN source IN (SELECT source FROM w) THEN source ELSE '{REST}' END AS source, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS twin FROM documents),
h AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || twin), 1, 15))::BIGINT AS hash FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id NULLS FIRST, twin) - 1 AS rank FROM h),
c AS (SELECT source, count(*) AS n, CAST((count(*) + {BLOCK_DOCS - 1}) // {BLOCK_DOCS} AS BIGINT) AS blocks FROM h GROUP BY source),
p AS (SELECT list(source ORDER BY source) AS names, list(unit::BIGINT ORDER BY source) AS u, list(blocks ORDER BY source) AS blocks FROM c JOIN w USING (source)),
s(slot, inner_slot, u, un, done, remain, chosen) AS (
  SELECT -1::BIGINT, 0::BIGINT, u, u, list_transform(u, lambda x: 0::BIGINT), blocks, NULL::BIGINT FROM p
  UNION ALL
  SELECT slot + 1, base + 1, u, units, list_transform(before, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END),
    list_transform(remain, lambda x, i: CASE WHEN i = best THEN x - 1 ELSE x END), best
  FROM (SELECT *, CASE WHEN remain[same] > 0 THEN same ELSE anew END AS best, CASE WHEN remain[same] > 0 THEN inner_slot ELSE 0 END AS base,
      CASE WHEN remain[same] > 0 THEN un ELSE un2 END AS units, CASE WHEN remain[same] > 0 THEN done ELSE list_transform(done, lambda x: 0::BIGINT) END AS before
    FROM (SELECT *, {pick('un', 'done', 'inner_slot')} AS same, {pick('un2', 'zero', '0')} AS anew
      FROM (SELECT *, list_transform(u, lambda x, i: CASE WHEN remain[i] > 0 THEN x ELSE 0 END) AS un2, list_transform(u, lambda x: 0::BIGINT) AS zero FROM s WHERE list_sum(remain) > 0)))),
b AS (SELECT names[chosen] AS source, slot, row_number() OVER (PARTITION BY chosen ORDER BY slot) - 1 AS block FROM s, p WHERE chosen IS NOT NULL),
e AS (SELECT b.source, block, slot, CAST(coalesce(sum(least({BLOCK_DOCS}, n - block * {BLOCK_DOCS})) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM b JOIN c ON c.source = b.source)
SELECT doc_id, own AS source, block, slot, start + rank % {BLOCK_DOCS} AS position FROM r JOIN e ON e.source = r.source AND e.block = r.rank // {BLOCK_DOCS}
"""


QUERIES = {"op7_pfair_mix": op7_pfair_mix}
ORACLE_SQL = {"op7_pfair_mix": _oracle()}
