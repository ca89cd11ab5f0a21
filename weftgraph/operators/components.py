"""Connected components as a distributed loop: min-label hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import discard, materialise

#: Labels (16 bytes each) that are broadcast at most; more meet in SALTS places each.
BROADCAST_LABELS, SALTS = 1_000_000, 16


def _jumped(hooked: DataFrame) -> DataFrame:
    """hooked (vid, old, mid) with mid's own mid as _m.

    A label that a giant component shares must not gather its members in one task: the distinct labels
    are broadcast if they are few, and else each is met in several places.
    """
    labels = hooked.select(F.col("mid").alias("_l")).distinct()
    labels = labels.join(hooked.select(F.col("vid").alias("_v"), F.col("mid").alias("_m")), F.col("_l") == F.col("_v")).select("_l", "_m")
    labels = materialise(labels, "cc-jumps")
    if labels.count() <= BROADCAST_LABELS:
        return hooked.join(F.broadcast(labels), hooked["mid"] == labels["_l"], "left")
    spread = labels.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.hash("vid"), F.lit(SALTS))
    return hooked.join(spread, (hooked["mid"] == spread["_l"]) & (salt == spread["_s"]), "left")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vid, component) of every endpoint; component is the smallest id that vid reaches.

    Each step takes the smallest label among neighbours (partial aggregation spares hubs) and then
    the label's own label, so chains shorten by half: steps grow with the logarithm of a diameter.
    Labels are written to the shared folder after each step. Null ids and self loops are ignored.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a") != F.col("b"))
    sym = materialise(ends.union(ends.select("b", "a")).distinct(), "cc-edges")
    labels = materialise(sym.groupBy(F.col("a").alias("vid")).agg(F.min("b").alias("m")).select("vid", F.least("vid", "m").alias("component")), "cc-labels")
    while True:
        near = sym.join(labels, sym["b"] == labels["vid"]).groupBy(F.col("a").alias("_v")).agg(F.min("component").alias("_m"))
        hooked = labels.join(near, labels["vid"] == near["_v"], "left").select("vid", F.col("component").alias("old"), F.least("component", "_m").alias("mid"))
        hooked = materialise(hooked, "cc-hooked")
        moved = _jumped(hooked).select("vid", "old", F.least("mid", "_m").alias("component"))
        moved = materialise(moved, "cc-labels")
        changed = not moved.where("old <> component").isEmpty()
        discard(labels, hooked)
        labels = moved
        if not changed:
            discard(sym)
            return labels.select("vid", "component")
