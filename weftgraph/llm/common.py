"""Shared pieces: reading tables, words, and let-bindings inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import discard, materialise, scratch_path, shared_dir  # noqa: F401

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once for each row and hands it to body, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str | Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than SEPARATORS; an empty array if there are none."""
    return let(
        F.btrim(text, F.lit(SEPARATORS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\x09-\\x0D]+", -1)),
    )


def without_separators(text: Column) -> Column:
    return F.translate(text, SEPARATORS, "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


#: Borders of ranges come from a sample of about this many keys a range, chosen by a hash of the key.
SAMPLED = 32
#: Bounds what the driver holds for the borders: SAMPLED * MAX_RANGES numbers.
MAX_RANGES = 20_000


def borders(keys: DataFrame, key: str, ranges: int, rows: int) -> list[int]:
    """Fewer than ``ranges`` ascending keys that cut the table into ranges of about equal counts.

    They depend on the keys alone, not on how the input is partitioned.
    """
    ranges = min(ranges, MAX_RANGES)
    step = max(1, rows // (ranges * SAMPLED))
    chosen = keys.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).select(key).distinct()
    found = sorted(r[0] for r in chosen.collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the key (a null key: none)."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast("long") for c in cuts]) if len(cuts) < 500 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    return F.when(key.isNull(), 0).otherwise(not_above(table, key, F.lit(len(cuts)), len(cuts)))


def not_above(table: Column, key: Column, size: Column, most: int) -> Column:
    """How many of a table's ascending values are at most the key, by binary search; it holds size values, at most most."""

    def step(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        right = F.get(at["table"], middle) <= at["key"]
        moved = F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"), F.when(right, at["high"]).otherwise(middle).alias("high"), at["key"].alias("key"), at["table"].alias("table"))
        return F.when(at["low"] < at["high"], moved).otherwise(at)

    start = F.struct(F.lit(0).alias("low"), size.cast("int").alias("high"), key.alias("key"), table.alias("table"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(most, 1).bit_length())), start, step, lambda at: at["low"])


def whole(docs: DataFrame) -> Column:
    """A row of docs as one struct named _row, beside which helper columns can have any names."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of _row."""
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def with_text(docs: DataFrame, text: Column) -> Column:
    """_row with its text replaced and, if it has one, n_chars set anew."""
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return F.struct(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns]).alias("_row")
