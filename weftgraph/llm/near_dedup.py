"""Near-duplicate groups: circulant MinHash, banding, and exact Jaccard verification.

A document's set holds its distinct k-word shingles (A-Z lower-cased; with fewer than k words the
whole sequence is one shingle; without words the set is empty and linked with nothing). Documents
are linked if 100 * |A & B| >= percent * |A | B|. Groups are the components of the links.

Method. One permutation sigma places a shingle on a ring of 2**32 positions; a second permutation
pi, shifted round the ring by 1, 2, 3, ... gives every signature coordinate (the least pi over the
shifted positions). Rows of coordinates form bands; the number of bands is chosen so that a pair
at the threshold misses all of them with a chance below MISS. Candidates are confirmed on the full
sets of 64-bit shingle hashes.

Scale. Copies with equal sets are one node. A bucket (documents with an equal band) never emits
all its pairs: a few pivots are compared with the members that are not yet in their component,
links are merged, and what is still split gets more pivots (FAN, FAN**2, ...) in the next round,
until every bucket lies in one component or each of its members has been a pivot. So no link is
lost, yet a group of n near copies costs about n comparisons. Exact bounds spare near misses: of a
candidate's n shingles at most s occur in any other candidate, so a pair shares at most the smaller
s, taken class by class of the shingles' hashes, and a document with too few has no link at all. Buckets, links and labels stay
distributed, and every round is written to the shared folder.

Defined cases: a null text is empty; a null doc_id is in no group (component_id null, kept);
repeated rows of a doc_id share its group; doc_id names one text; an empty table gives no rows;
other columns are ignored by :func:`groups` and kept by :func:`dedup`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import discard, let, materialise, read, text_of, total, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS, MISS = 6, 1e-6
#: Growth of a bucket's pivots from round to round.
FAN = 16
#: Classes of shingle hashes whose shared counts bound what a pair can share.
CLASSES = 32
#: Partners of a pivot that one task compares, and counts of larger pivots (12 bytes each) that are broadcast at most.
PIVOT_ROWS, BROADCAST_PIVOTS = 256, 1_000_000
#: Members of a bucket that meet its pivots in one task, pairs for which another task pays, and pivots (about 200 bytes each) that are broadcast at most.
MEMBERS, TASK_PAIRS, BROADCAST_ROWS = 1024, 20_000, 100_000
#: Rows of (shingle, shift) that are mixed at a time, so that they stay in the CPU's cache.
BLOCK = 256


def shingles(text: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the k-word shingles of a text."""

    def of(w: Column) -> Column:
        runs = F.transform(F.slice(w, F.lit(1), F.size(w) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(F.array_distinct(runs))

    return let(words(F.translate(text, UPPER, LOWER)), of)


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def signatures(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Circulant MinHash of each list values[offsets[i]:offsets[i+1]]; all ones for an empty list."""
    ring = ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)  # sigma
    shifts = np.arange(1, width + 1, dtype=np.uint32)
    out = np.full((len(offsets) - 1, width), 0xFFFFFFFF, dtype=np.uint32)
    x, y = np.empty((BLOCK, width), np.uint32), np.empty((BLOCK, width), np.uint32)
    for i in range(len(offsets) - 1):
        for start in range(offsets[i], offsets[i + 1], BLOCK):
            part = ring[start : min(start + BLOCK, offsets[i + 1])]
            a, b = x[: len(part)], y[: len(part)]
            np.add(part[:, None], shifts, out=a)  # the circular shift, modulo 2**32
            for multiplier, shift in ((0x7FEB352D, 15), (0x846CA68B, 16)):  # pi: each step is a bijection
                np.multiply(a, np.uint32(multiplier), out=a)
                np.right_shift(a, np.uint32(shift), out=b)
                np.bitwise_xor(a, b, out=a)
            np.multiply(a, np.uint32(0x9E3779B1), out=a)
            np.minimum(out[i], a.min(axis=0), out=out[i])
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each document; equal bands at one place give equal keys."""
    parts = signature.reshape(len(signature), bands, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("_set"))
        offsets = np.asarray(lists.offsets)
        keys = band_keys(signatures(np.asarray(lists.values), offsets, bands * ROWS), bands)
        keys_of = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], keys_of], names=[*batch.schema.names[:-1], "bands"])


def _nodes(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, rep (the smallest doc_id with an equal set) and, for reps, the band keys."""
    sets = docs.select("doc_id", F.sort_array(shingles(text_of("text"), k)).alias("_set"))
    sets = sets.select("doc_id", F.size("_set").cast("long").alias("n_shingles"), F.xxhash64("_set").alias("k1"), F.xxhash64(F.lit(1), "_set").alias("k2"), "_set")
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
    banded = materialise(sets.mapInArrow(lambda it: _banded(it, bands), schema), "nd-bands")
    same = materialise(banded.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "nd-equal")
    same = same.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("n_shingles").alias("_n"), "rep")
    on = (banded["k1"] == same["_1"]) & (banded["k2"] == same["_2"]) & (banded["n_shingles"] == same["_n"])
    out = banded.join(same, on, "left").select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"))
    out = materialise(out, "nd-nodes")
    discard(banded, same)
    return out


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, pivot) that are links by their full sets.

    A pivot with more than PIVOT_ROWS partners is dealt to several tasks, each with a copy of its set.
    """
    counts = pairs.groupBy(F.col("pivot").alias("_p")).agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("_salts"))
    counts = materialise(counts, "nd-pivots")
    many = counts.where("_salts > 1")
    many = F.broadcast(many) if many.count() <= BROADCAST_PIVOTS else many
    salted = pairs.join(many, pairs["pivot"] == many["_p"], "left").select("a", "pivot", F.pmod(F.xxhash64("a"), F.coalesce("_salts", F.lit(1))).cast("int").alias("salt"))
    goes = salted.groupBy(F.col("a").alias("_id")).agg(F.collect_set(F.struct("pivot", "salt")).alias("_to"))
    mine = sets.join(goes, sets["rep"] == goes["_id"]).select(F.col("rep").alias("a"), F.col("set").alias("_a"), F.explode("_to").alias("_t"))
    mine = mine.select("a", "_a", F.col("_t.pivot").alias("pivot"), F.col("_t.salt").alias("salt"))
    theirs = sets.join(counts, sets["rep"] == counts["_p"]).select("_p", F.col("set").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_s"))
    both = mine.join(theirs, (mine["pivot"] == theirs["_p"]) & (mine["salt"] == theirs["_s"]))
    shared = both.select("a", "pivot", F.size(F.array_intersect("_a", "_b")).cast("long").alias("i"), (F.size("_a") + F.size("_b")).cast("long").alias("s"))
    return shared.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "pivot").distinct()


def _shared_counts(sets: DataFrame) -> DataFrame:
    """_id, classes: for each of CLASSES classes of hashes, how many of a candidate's shingles another candidate has too."""
    each = sets.select("rep", F.explode("set").alias("h"))
    alone = each.groupBy("h").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1").select("rep", "h")

    def counts(rows: DataFrame, sign: int) -> DataFrame:
        of = F.pmod("h", F.lit(CLASSES))
        return rows.groupBy("rep").agg(*[F.sum(F.when(of == c, sign).otherwise(0)).alias(f"c{c}") for c in range(CLASSES)])

    both = counts(each, 1).union(counts(alone, -1))
    sums = both.groupBy(F.col("rep").alias("_id")).agg(*[F.sum(f"c{c}").cast("int").alias(f"c{c}") for c in range(CLASSES)])
    return sums.select("_id", F.array(*[f"c{c}" for c in range(CLASSES)]).alias("classes"))


def _most_shared(a: Column, b: Column) -> Column:
    """An upper bound of what two candidates share: they can share no more of a class than either has."""
    return total(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("long")))


def _compared(still: DataFrame, pivots: DataFrame, on: Column, work: int) -> DataFrame:
    """still joined with the pivots of each row's bucket.

    The rows are small and their pairs many, so tasks are dealt by pairs, not by bytes: members are spread
    over tasks that all have the pivots if those are few (counted), and else a bucket of more than MEMBERS
    rows meets copies of its pivots in several places.
    """
    if still.where("pivot").count() <= BROADCAST_ROWS:
        most = int(still.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return still.repartition(max(1, min(most, work // TASK_PAIRS)), "key", "rep").join(F.broadcast(pivots), on)
    places = F.ceil(F.col("_m") / MEMBERS).cast("int")
    copied = pivots.withColumn("_place", F.explode(F.sequence(F.lit(0), places - 1)))
    place = F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / MEMBERS)).cast("int")
    return still.withColumn("place", place).join(copied, on & (F.col("place") == F.col("_place")))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """vid, component after adding links to the components known so far."""
    if labels is None:
        return connected_components(links, "a", "pivot")
    known = labels.select(F.col("vid").alias("_v"), F.col("component").alias("_c"))
    ends = links.join(known, links["a"] == known["_v"], "left").select(F.coalesce("_c", "a").alias("a"), "pivot")
    ends = ends.join(known, ends["pivot"] == known["_v"], "left").select("a", F.coalesce("_c", "pivot").alias("pivot"))
    step = connected_components(ends, "a", "pivot").select(F.col("vid").alias("_v"), F.col("component").alias("_c"))
    old = labels.join(step, labels["component"] == step["_v"], "left").select("vid", F.coalesce("_c", "component").alias("component"))
    new = step.join(labels, step["_v"] == labels["vid"], "left_anti").select(F.col("_v").alias("vid"), F.col("_c").alias("component"))
    return old.union(new)


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the smallest doc_id of its group) of every row."""
    nodes = _nodes(docs, k, bands_for(percent))
    members = nodes.where("bands IS NOT NULL").select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    split = materialise(members.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select(F.col("key").alias("_key")), "nd-keys")
    met = materialise(members.join(split, F.col("key") == F.col("_key")).select("key", "rep", "n"), "nd-met")
    # The candidates' sets: texts move once, for documents that share a band with another.
    wanted = met.select(F.col("rep").alias("_id")).distinct()
    sets = materialise(docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id")).select(F.col("_id").alias("rep"), shingles(text_of("text"), k).alias("set")), "nd-sets")
    shared = _shared_counts(sets).withColumn("s", total(F.transform("classes", lambda x: x.cast("long"))))
    buckets = met.join(shared, met["rep"] == shared["_id"]).where(100 * F.col("s") >= percent * F.col("n"))
    buckets = materialise(buckets.select("key", "rep", "n", "s", "classes", F.col("rep").alias("label")), "nd-buckets")
    discard(split, met)
    labels, depth = None, 0
    while True:
        state = buckets.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(1 - F.col("s") / F.col("n"), "rep")).alias("f"), F.count("*").alias("m"), F.min("n").alias("least")).where("lo < hi")
        state = materialise(state.select(F.col("key").alias("_key"), F.col("f.rep").alias("first"), "m", "least"), "nd-open")
        tried = F.least(F.col("m"), F.lit(FAN**depth))
        work = state.agg(F.sum(F.col("m").cast("double") * tried)).first()[0]
        if work is None:
            discard(state, buckets)
            break
        chance = F.pmod(F.xxhash64("key", "rep", F.lit(depth)), F.lit(1 << 30)) < F.lit(float(FAN**depth * (1 << 30))) / F.col("m")
        is_pivot = (F.col("rep") == F.col("first")) if depth == 0 else ((F.col("rep") == F.col("first")) | chance)
        # A partner has at least `least` shingles, and at most s of them are shared.
        hopeful = 100 * F.col("s") >= percent * (F.col("n") + F.greatest("least", "s") - F.col("s"))
        still = buckets.join(state, F.col("key") == F.col("_key")).where(hopeful | is_pivot)
        still = materialise(still.select("key", "rep", "n", "s", "classes", "label", "m", is_pivot.alias("pivot")), "nd-still")
        pivots = still.where("pivot").select(F.col("key").alias("_key"), F.col("rep").alias("_rep"), F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("classes").alias("_classes"), F.col("label").alias("_label"), F.col("m").alias("_m"))
        most = F.least("s", "_s")
        fits = 100 * most >= percent * (F.col("n") + F.col("_n") - most)
        finer = _most_shared(F.col("classes"), F.col("_classes"))
        fits_finely = 100 * finer >= percent * (F.col("n") + F.col("_n") - finer)
        # A pair of two pivots is met from both sides; the smaller id is then the pivot.
        once = ~F.col("pivot") | (F.col("rep") > F.col("_rep"))
        on = (F.col("key") == F.col("_key")) & (F.col("label") != F.col("_label")) & once & fits & fits_finely
        pairs = _compared(still, pivots, on, int(work)).select(F.col("rep").alias("a"), F.col("_rep").alias("pivot")).distinct()
        pairs = materialise(pairs, "nd-pairs")
        links = materialise(_confirmed(sets, pairs, percent), "nd-links")
        rest = still.where("NOT pivot").drop("pivot", "m")
        if not links.isEmpty():
            labels = materialise(_merged(labels, links), "nd-labels")
        if labels is not None:
            rest = rest.join(labels, rest["rep"] == labels["vid"], "left").select("key", "rep", "n", "s", "classes", F.coalesce("component", "label").alias("label"))
        following = materialise(rest.select("key", "rep", "n", "s", "classes", "label"), "nd-buckets")
        discard(state, still, pairs, links, buckets)
        buckets, depth = following, depth + 1
    discard(sets)
    out = nodes.select("doc_id", "n_shingles", "rep")
    if labels is not None:
        out = out.join(labels, out["rep"] == labels["vid"], "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", group.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that another document of their group stands for.

    Of repeated rows with one doc_id one stays; rows without doc_id all stay.
    """
    gone = groups(docs, k, percent).where("NOT kept").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
