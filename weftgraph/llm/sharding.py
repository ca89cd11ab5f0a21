"""Sharding by a Feistel permutation with cycle walking over global row numbers (law ``rows``).

Rows get gapless numbers 0..N-1 in the order of (doc_id, size, crc); a keyed bijection of 0..N-1
shuffles them; the permuted number p gives shard ``p mod n`` and slot ``p div n``. Shard and slot
of a row follow from its number alone, so a reader can compute, and invert, any position.

The bijection is a Feistel network on Z_a x Z_b with a = ceil(sqrt N), b = ceil(N / a), whose
results beyond N-1 are walked on along their cycle. All arithmetic stays below 2**63.

Defined cases: a null text counts as empty (size 8, crc 0); a null doc_id sorts first; repeated
rows are rows of their own and get numbers of their own; an empty table gives no rows; other
columns are ignored by :func:`assign` and kept by :func:`shard`, whose own columns replace
columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialise, read, text_of, whole

#: Primes below 2**31: squares of residues fit a signed 64-bit integer.
PRIME, PRIME_2 = 2_147_483_647, 2_147_483_629
ROUNDS = 6
#: Most steps of a cycle walk; a walk that is still outside then raises an error.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and increment of each round, from the seed by a multiplicative generator."""
    keys, state = [], (seed * 48_271 + 11) % PRIME or 1
    for _ in range(ROUNDS):
        state = state * 48_271 % PRIME
        multiplier = state
        state = state * 48_271 % PRIME
        keys.append((multiplier, state))
    return keys


def sides(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square with at least n cells."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, seed: int) -> int:
    """The permutation of 0..n-1 for one number, for readers that compute positions."""
    a, b = sides(n)
    while True:
        left, right = x // b, x % b
        for k, (m, c) in enumerate(round_keys(seed)):
            if k % 2 == 0:
                left = (left + _mix(right, m, c)) % a
            else:
                right = (right + _mix(left, m, c)) % b
        x = left * b + right
        if x < n:
            return x


def invert(y: int, n: int, seed: int) -> int:
    """The row number whose permuted number is y."""
    a, b = sides(n)
    keys = list(enumerate(round_keys(seed)))[::-1]
    while True:
        left, right = y // b, y % b
        for k, (m, c) in keys:
            if k % 2 == 0:
                left = (left - _mix(right, m, c)) % a
            else:
                right = (right - _mix(left, m, c)) % b
        y = left * b + right
        if y < n:
            return y


def _mix(r: int, m: int, c: int) -> int:
    x = (r % PRIME * m + c) % PRIME
    return x * x % PRIME_2


def permuted(number: Column, n: int, seed: int) -> Column:
    """permute() as one SQL expression. The walk's steps are evaluated only while outside 0..n-1."""
    a, b = (F.lit(s).cast("long") for s in sides(n))
    prime, prime_2 = F.lit(PRIME).cast("long"), F.lit(PRIME_2).cast("long")

    def mixed(r: Column, m: int, c: int) -> Column:
        return let((r % prime * F.lit(m).cast("long") + F.lit(c).cast("long")) % prime, lambda x: x * x % prime_2)

    def round_of(k: int, m: int, c: int):
        if k % 2 == 0:
            return lambda s: F.struct(((s["l"] + mixed(s["r"], m, c)) % a).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"], m, c)) % b).alias("r"))

    def step(x: Column) -> Column:
        state = F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r"))
        for k, (m, c) in enumerate(round_keys(seed)):
            state = let(state, round_of(k, m, c))
        return let(state, lambda s: s["l"] * b + s["r"])

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        step(number),
        lambda y, _: F.when(y < n, y).otherwise(step(y)),
        lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk did not end"))),
    )


def numbered(slim: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_number 0..N-1 in the order of the columns given, without a global sort in one task.

    A range partitioning is written once with its partition ids, so that later reads agree on it;
    each row's number is its rank in its partition plus the sizes of the partitions before. Only
    one row a partition meets in one task for the running sum.
    """
    ranged = slim.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return (
        ranged.withColumn("_rank", rank)
        .join(offsets, "_pid")
        .withColumn("row_number", F.col("_rank") + F.col("_offset"))
        .drop("_pid", "_rank", "_offset")
    )


def assign(docs: DataFrame, n_shards: int = 24, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row. Counts differ by one at most."""
    slim = docs.select("doc_id", F.octet_length(text_of("text")).cast("long").alias("_bytes"), F.crc32(text_of("text").cast("binary")).alias("text_crc32"))
    slim = slim.select("doc_id", (F.col("_bytes") + 8).alias("size"), "text_crc32")
    rows = numbered(slim, ["doc_id", "size", "text_crc32"])
    n = max(1, rows.count())
    spot = rows.withColumn("_p", permuted(F.col("row_number"), n, seed))
    return spot.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("_p") % n_shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_p"), F.lit(n_shards).cast("long")).alias("slot"),
    )


def shard(docs: DataFrame, key: str, n_shards: int = 24, seed: int = 42) -> DataFrame:
    """Whole rows with shard and slot; texts move once. Keys are meant to be unique: rows of one key meet in a task.

    Rows that repeat a key share that key's numbers among themselves, one each.
    """
    spots = numbered(docs.select(F.col(key).alias("_key")), ["_key"])
    n = max(1, spots.count())
    number = permuted(F.col("row_number"), n, seed)
    spots = spots.select("_key", let(number, lambda p: F.struct((p % n_shards).cast("int").alias("shard"), F.call_function("div", p, F.lit(n_shards).cast("long")).alias("slot"))).alias("_spot"))
    spots = spots.groupBy("_key").agg(F.sort_array(F.collect_list("_spot")).alias("_spots"))
    kept = docs.drop("shard", "slot")
    rows = kept.select(whole(kept), kept[key].alias("_own")).join(spots, F.col("_own").eqNullSafe(F.col("_key")))
    twin = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    rows = rows.withColumn("_spot", F.get("_spots", twin - 1))
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept.columns], "_spot.shard", "_spot.slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = assign(read(spark, sf_dir, "documents"))
    return spots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle(n_shards: int = 24, seed: int = 42) -> str:
    def rounds(source: str, prefix: str) -> str:
        """CTEs that apply one permutation step to source(rid, x, n, a, b)."""
        out = [f"{prefix}0 AS (SELECT rid, n, a, b, x // b AS l, x % b AS r FROM {source})"]
        for k, (m, c) in enumerate(round_keys(seed)):
            half, side, other = ("r", "a", "l") if k % 2 == 0 else ("l", "b", "r")
            mix = f"((({half} % {PRIME}) * {m} + {c}) % {PRIME})"
            new = f"(({other} + ({mix} * {mix}) % {PRIME_2}) % {side})"
            cols = f"{new} AS l, r" if k % 2 == 0 else f"l, {new} AS r"
            out.append(f"{prefix}{k + 1} AS (SELECT rid, n, a, b, {cols} FROM {prefix}{k})")
        return ", ".join(out)

    step = rounds("walk_in", "w")
    return f"""
WITH RECURSIVE bits AS (
  SELECT k, 0 AS i, k::BIGINT AS v FROM range(256) t(k)
  UNION ALL SELECT k, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8),
tab AS (SELECT list(v ORDER BY k) AS t FROM bits WHERE i = 8),
docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
crcs AS (SELECT doc_id, length(hx) // 2 + 8 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hx, '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda acc, c: xor(acc >> 8, t[xor(acc & 255, c) + 1]))) AS text_crc32
  FROM docs, tab),
side AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents))),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS rid FROM crcs),
walk AS (
  SELECT rid, rid AS x, 0 AS done, n, a, b FROM numbered, side
  UNION ALL
  SELECT * FROM (WITH walk_in AS (SELECT rid, x, n, a, b FROM walk WHERE done = 0 OR x >= n), {step}
    SELECT rid, l * b + r AS x, 1 AS done, n, a, b FROM w{ROUNDS})),
ends AS (SELECT rid, x FROM walk WHERE done = 1 AND x < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(x % {n_shards} AS INTEGER) AS shard, CAST(x // {n_shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN ends USING (rid)
"""


QUERIES = {"op8_sharding": op8_sharding}
ORACLE_SQL = {"op8_sharding": _oracle()}
