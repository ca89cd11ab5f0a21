"""Focused clusters and their outliers on weighted graphs.

A core (a vertex and its neighbours by heavy edges) grows by the outside vertex that lowers the
conductance most, and then shrinks by members whose removal doesn't raise it. Conductance is cut over
inner weight, where negative weights don't count.

A cluster keeps its sums: what a vertex would change follows from its edges to the members and its
total weight, so joining or leaving costs the vertex's own list. For sums that do not depend on the
order of terms, weights are rounded to multiples of a power of two so small that every sum is exact
(to 51 bits of the graph's total weight). Ties go to the smallest id.

A graph of a checked size (BROADCAST_BYTES) is broadcast once as arrays, and each core grows in one go
where its row is. A larger graph is pulled in the task model: a task has the lists of its members and
candidates, and goes on by itself until a vertex without a list is to join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import materialise
from .graph import Graph
from .tasks import run

#: Lists are broadcast if the counted edges take at most so many bytes (16 for each end).
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Focus:
    """Heavy edge from, least core and result sizes, gain that counts as none, outer rounds, candidates a member."""

    min_weight: float = 1.0
    min_core: int = 10
    min_result: int = 0
    diff_ratio: float = 0.01
    max_rounds: int = 10
    candidates: float = 20.0


def exact_unit(graph: Graph) -> float:
    """The power of two to whose multiples weights are rounded in sums."""
    total = graph.edges.agg(F.sum(F.abs(F.col("weight").cast("double")))).first()[0]
    return 2.0 ** (math.frexp(2 * total if total else 1.0)[1] - 51)


def neighbourhoods(graph: Graph, unit: float = 2.0**-20) -> DataFrame:
    """vid, adj of (id, weight) ascending, with the neighbour's total weight and edge count beside (negatives left out)."""
    sym = graph.sym().select("src", "dst", F.col("weight").cast("double").alias("weight"))
    rounded = F.rint(F.col("weight") / unit) * unit
    fair = sym.where("weight >= 0").groupBy(F.col("src").alias("_v")).agg(F.sum(rounded).alias("total"), F.count("*").alias("degree"))
    entry = F.struct(F.col("dst").alias("id"), "weight", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return sym.join(fair, F.col("dst") == F.col("_v"), "left").groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list(entry)).alias("adj"))


def cores(near: DataFrame, options: Focus = Focus()) -> DataFrame:
    """vid, core: the seed, then its heavy neighbours ascending; of min_core vertices at least."""
    heavy = F.transform(F.filter("adj", lambda n: n["weight"] >= options.min_weight), lambda n: n["id"])
    return near.select("vid", F.concat(F.array("vid"), heavy).alias("core")).where(F.size("core") >= options.min_core)


def _weighted(graph: Graph) -> DataFrame:
    return graph.sym().select("src", "dst", F.col("weight").cast("double").alias("weight"))


def heavy_cores(graph: Graph, options: Focus = Focus()) -> DataFrame:
    """What cores() gives of the graph's neighbourhoods, from its heavy edges alone."""
    sym = _weighted(graph)
    heavy = F.col("weight") >= options.min_weight
    rows = sym.where(heavy) if options.min_core > 1 else sym  # a core of one needs no heavy edge
    lists = rows.groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list(F.when(heavy, F.col("dst")))).alias("h"))
    return lists.select("vid", F.concat(F.array("vid"), "h").alias("core")).where(F.size("core") >= options.min_core)


@dataclass(frozen=True)
class Lists:
    """Neighbour lists as arrays. A vertex is named by its place among the ascending ids."""

    ids: np.ndarray
    total: np.ndarray
    degree: np.ndarray
    start: np.ndarray
    near: np.ndarray
    weight: np.ndarray
    known: np.ndarray
    unit: float

    @classmethod
    def of_edges(cls, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, unit: float) -> "Lists":
        """Of all edges of a graph, each given once."""
        ids, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
        a, b, w = ends, np.concatenate((ends[len(src) :], ends[: len(src)])), np.concatenate((weight, weight))
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order].astype(np.int32), w[order]
        fair = w >= 0
        total = np.bincount(a, np.where(fair, np.rint(w / unit) * unit, 0.0), len(ids))
        start = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=len(ids)))))
        return cls(ids, total, np.bincount(a, fair, len(ids)).astype(np.int64), start, b, w, np.ones(len(ids), bool), unit)

    @classmethod
    def of_front(cls, front: list[dict[str, Any]], unit: float) -> "Lists":
        """Of the pulled vertices; their neighbours are there without lists."""
        rows = sorted(front, key=lambda f: f["vid"])
        entries = [e for f in rows for e in f["adj"]]
        own, other = np.array([f["vid"] for f in rows], np.int64), np.array([e["id"] for e in entries], np.int64)
        ids = np.unique(np.concatenate((own, other)))
        total, degree, sizes = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        weight = np.array([e["weight"] for e in entries], np.float64)
        at, places = np.searchsorted(ids, own), np.searchsorted(ids, other).astype(np.int32)
        sizes[at] = [len(f["adj"]) for f in rows]
        owner = np.repeat(at, sizes[at])
        fair = weight >= 0
        total += np.bincount(owner, np.where(fair, np.rint(weight / unit) * unit, 0.0), len(ids))
        degree += np.bincount(owner, fair, len(ids)).astype(np.int64)
        total[places], degree[places] = [e["total"] for e in entries], [e["degree"] for e in entries]
        known = np.zeros(len(ids), bool)
        known[at] = True
        return cls(ids, total, degree, np.concatenate(([0], np.cumsum(sizes))), places, weight, known, unit)

    def of(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.start[v], self.start[v + 1]
        return self.near[low:high], self.weight[low:high]

    def places(self, ids: list[int]) -> list[int]:
        return np.searchsorted(self.ids, np.array(ids, np.int64)).tolist()


class Cluster:
    """Members with their sums, and what each outside vertex has to do with them."""

    def __init__(self, lists: Lists, members: list[int]):
        n = len(lists.ids)
        self.lists, self.order, self.size = lists, [], 0
        self.inside, self.reached = np.zeros(n, bool), np.zeros(n, bool)
        self.tie, self.ties = np.zeros(n), np.zeros(n, np.int64)
        #: The smallest member from which a vertex is met by positive weight, and that weight.
        self.first, self.first_weight = np.full(n, n, np.int64), np.zeros(n)
        self.frontier, self.met = np.empty(64, np.int64), 0
        self.cut = self.inner = 0.0
        self.n_cut = self.n_inner = 0
        for v in members:
            self.join(v)

    def join(self, v: int) -> None:
        near, weight = self.lists.of(v)
        self.cut += self.lists.total[v] - 2 * self.tie[v]
        self.inner += self.tie[v]
        self.n_cut += int(self.lists.degree[v] - 2 * self.ties[v])
        self.n_inner += int(self.ties[v])
        self.inside[v] = True
        self.order.append(v)
        self.size += 1
        self._tied(near, weight, 1)
        self._meet(v, near, weight)

    def _tied(self, near: np.ndarray, weight: np.ndarray, sign: int) -> None:
        fair = weight >= 0
        near = near[fair]
        self.tie[near] += sign * (np.rint(weight[fair] / self.lists.unit) * self.lists.unit)
        self.ties[near] += sign

    def _meet(self, v: int, near: np.ndarray, weight: np.ndarray) -> None:
        sooner = (weight > 0) & (self.first[near] > v)
        near, weight = near[sooner], weight[sooner]
        self.first[near], self.first_weight[near] = v, weight
        new = near[~self.reached[near]]
        self.reached[new] = True
        if self.met + len(new) > len(self.frontier):
            self.frontier = np.resize(self.frontier, 2 * (self.met + len(new)))
        self.frontier[self.met : self.met + len(new)] = new
        self.met += len(new)

    def leave(self, v: int) -> None:
        """The vertex leaves; who is met first is not known until meet_again()."""
        self.inside[v] = False
        self.size -= 1
        self._tied(*self.lists.of(v), -1)
        self.cut -= self.lists.total[v] - 2 * self.tie[v]
        self.inner -= self.tie[v]
        self.n_cut -= int(self.lists.degree[v] - 2 * self.ties[v])
        self.n_inner -= int(self.ties[v])

    def meet_again(self) -> None:
        self.order = [v for v in self.order if self.inside[v]]
        self.first[:], self.reached[:], self.met = len(self.first), False, 0
        for v in sorted(self.order):
            self._meet(v, *self.lists.of(v))

    def phi(self) -> float:
        return self.cut / self.inner if self.inner else -1.0

    def outside(self, most: float) -> np.ndarray:
        """Outside vertices met by positive weight; the heaviest most of them by the weight met first.

        Ties go to those of the smaller member, then to the smaller id.
        """
        found = self.frontier[: self.met]
        found = found[~self.inside[found]]
        return _heaviest(found, self.first_weight[found], self.first[found], len(self.inside), int(most)) if len(found) > most else found

    def outside_of_core(self, most: float) -> np.ndarray:
        """The same with members met in the order they joined, as is right for the first candidates."""
        rank, weight_of = np.full(len(self.inside), -1, np.int64), np.zeros(len(self.inside))
        for at, v in enumerate(self.order):
            near, weight = self.lists.of(v)
            new = (weight > 0) & (rank[near] < 0)
            rank[near[new]], weight_of[near[new]] = at, weight[new]
        found = np.flatnonzero((rank >= 0) & ~self.inside)
        return _heaviest(found, weight_of[found], rank[found], len(self.inside), int(most)) if len(found) > most else found

    def best_additions(self, candidates: np.ndarray) -> tuple[float, int | None, int | None]:
        """Greatest drop of conductance and its vertex, and the vertex of the greatest drop by counts of edges."""
        c = candidates[self.ties[candidates] > 0]
        tie, ties = self.tie[c], self.ties[c]
        new_inner, new_n = self.inner + tie, self.n_inner + ties
        fit = (new_inner != 0) & (new_n != 0)
        if not fit.all():
            c, tie, ties, new_inner, new_n = c[fit], tie[fit], ties[fit], new_inner[fit], new_n[fit]
        if not len(c):
            return 0.0, None, None
        change = (self.cut - tie + (self.lists.total[c] - tie)) / new_inner - self.phi()
        shape = (self.n_cut - ties + (self.lists.degree[c] - ties)) / new_n - (self.n_cut / self.n_inner if self.n_inner else -1.0)
        drop, shape_drop = change.min(), shape.min()
        node = int(c[change == drop].min()) if drop < 0 else None
        shape_node = int(c[shape == shape_drop].min()) if shape_drop < 0 else None
        return float(min(drop, 0.0)), node, shape_node

    def shrink(self) -> bool:
        """Removes members, ascending, while a removal does not raise the conductance; whether any went."""
        phi, gone, again = self.phi(), False, True
        while again:
            again = False
            for v in np.flatnonzero(self.inside).tolist():
                tie = float(self.tie[v])
                inner = self.inner - tie
                new = (self.cut - float(self.lists.total[v]) + 2 * tie) / inner if inner else -1.0
                if 0 <= new <= phi:
                    self.leave(v)
                    phi, gone, again = new, True, True
        if gone:
            self.meet_again()
        return gone


def _heaviest(found: np.ndarray, weight: np.ndarray, rank: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k of found that are first by (weight descending, rank, place)."""
    if k <= 0:
        return found[:0]
    least = np.partition(weight, len(weight) - k)[len(weight) - k]
    sure, tied = found[weight > least], np.flatnonzero(weight == least)
    want = k - len(sure)
    if want < len(tied):
        tied = tied[np.argpartition(rank[tied] * n + found[tied], want - 1)[:want]]
    return np.concatenate((sure, found[tied]))


def _close(smaller: float, larger: float, ratio: float) -> bool:
    """Whether larger / smaller is at most 1 + ratio, by the rules of floating point."""
    if smaller == 0:
        return False if larger >= 0 else True
    return larger / smaller <= 1 + ratio


def advance(lists: Lists, state: dict[str, Any], options: Focus) -> tuple[dict[str, Any], list[int], bool]:
    """Grows a cluster as far as the lists allow: its state, the ids whose lists it needs, whether it goes on."""
    cluster = Cluster(lists, lists.places(state["members"]))
    outlier, rounds, start = set(lists.places(state["outlier"])), state["rounds"], state["start"]

    def ids(places: Any) -> list[int]:
        return lists.ids[np.array(list(places), np.int64)].tolist()

    def most() -> float:
        return options.candidates * cluster.size

    def now(found: bool, candidates: Any = ()) -> dict[str, Any]:
        kept = {"members": ids(cluster.order), "outlier": sorted(ids(outlier)), "candidates": ids(candidates), "rounds": rounds, "start": start}
        return {**state, **kept, "begun": True, "found": found, "phi": cluster.phi() if found else -1.0}

    candidates = np.array(lists.places(state["candidates"]), np.int64) if state["begun"] else cluster.outside_of_core(most())
    while True:
        phi = cluster.phi()
        if phi < 0:
            return now(False), [], False
        start = phi if start is None else start
        drop, node, shape_node = cluster.best_additions(candidates)
        if not _close(phi + drop, phi, options.diff_ratio):
            if node is not None and not lists.known[node]:
                return now(False, candidates), ids([*cluster.order, *candidates.tolist()]), True
            if shape_node is not None:
                outlier.add(shape_node)
            if node is not None:
                cluster.join(node)
                candidates = cluster.outside(most())
                continue
        if cluster.shrink():
            outlier -= set(cluster.order)
            candidates = cluster.outside(most())
        phi = cluster.phi()
        if not _close(phi, start, options.diff_ratio) and rounds < options.max_rounds:
            start, rounds = phi, rounds + 1
            continue
        return now(cluster.size >= options.min_result), [], False


STATE = "members array<bigint>, outlier array<bigint>, candidates array<bigint>, rounds int, start double, begun boolean, phi double, found boolean"
FRESH = {"outlier": [], "candidates": [], "rounds": 0, "start": None, "begun": False, "phi": -1.0, "found": False}


def _grown(batches: Iterator[pd.DataFrame], shared: Any, options: Focus) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for vid, core in zip(batch["vid"], batch["core"], strict=True):
            state, _, _ = advance(shared.value, {**FRESH, "members": [int(v) for v in core]}, options)
            if state["found"]:
                rows.append((vid, state["members"], state["outlier"], state["phi"]))
        yield pd.DataFrame(rows, columns=["task_id", "members", "outlier", "phi"])


def clusters(graph: Graph, options: Focus = Focus(), dedupe: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """members (in the order they joined), outlier (ascending), phi.

    Equal member lists count once; equal sets from different seeds stay apart, as their order differs,
    unless dedupe. An outlier may also be a member: only shrinking takes members off the outliers.
    """
    spark, unit = graph.edges.sparkSession, exact_unit(graph)
    seeds = heavy_cores(graph, options)
    if 32 * graph.edges.count() <= broadcast_bytes:
        edges = graph.edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).toArrow()
        shared = spark.sparkContext.broadcast(Lists.of_edges(*[edges.column(c).to_numpy() for c in ("src", "dst", "weight")], unit))
        parts = 4 * spark.sparkContext.defaultParallelism  # cores take long: deal them out evenly
        done = seeds.repartition(parts, "vid").mapInPandas(lambda it: _grown(it, shared, options), "task_id long, members array<bigint>, outlier array<bigint>, phi double")
    else:
        fresh = [F.lit(None).cast("double").alias(c) if c == "start" else (F.array().cast("array<bigint>") if v == [] else F.lit(v)).alias(c) for c, v in FRESH.items()]
        state = seeds.select(F.col("vid").alias("task_id"), F.col("core").alias("pull"), F.col("core").alias("members"), *fresh)
        done = run(state, neighbourhoods(graph, unit), lambda state, front, interim: advance(Lists.of_front(front, unit), state, options)).where("found")
    key = F.sort_array("members") if dedupe else F.col("members")
    # Of equal lists that of the smallest seed stays.
    return done.groupBy(key.alias("_k")).agg(F.min(F.struct("task_id", "members", "outlier", "phi")).alias("m")).select("m.members", "m.outlier", "m.phi")


def size_histogram(found: DataFrame) -> DataFrame:
    """size, clusters."""
    return found.groupBy(F.size("members").alias("size")).agg(F.count("*").alias("clusters"))


def core_conductance(graph: Graph, options: Focus = Focus()) -> DataFrame:
    """vid, core_size, cut, inner, phi of every core, as joins."""
    core = materialise(heavy_cores(graph, options), "fco-cores").select("vid", F.size("core").alias("core_size"), F.explode("core").alias("m"))
    entries = _weighted(graph).select(F.col("src").alias("m"), F.col("dst").alias("n"), "weight").where("weight >= 0")
    each = core.join(entries, "m").join(core.select("vid", F.col("m").alias("n"), F.lit(True).alias("inside")), ["vid", "n"], "left")
    found = each.groupBy("vid", "core_size").agg(
        F.sum(F.when(F.col("inside").isNull(), F.col("weight")).otherwise(0.0)).alias("cut"),
        F.sum(F.when(F.col("inside") & (F.col("m") < F.col("n")), F.col("weight")).otherwise(0.0)).alias("inner"),
    )
    return found.withColumn("phi", F.when(F.col("inner") != 0, F.col("cut") / F.col("inner")).otherwise(F.lit(-1.0)))


def first_candidates(graph: Graph, options: Focus = Focus()) -> DataFrame:
    """vid, candidate, weight, place: each core's heaviest outside neighbours, at most candidates * core size.

    A candidate's weight is that of its first edge from the core (the seed's, then ascending ids).
    """
    core = materialise(heavy_cores(graph, options), "fco-cores").select("vid", F.size("core").alias("core_size"), F.posexplode("core").alias("at", "m"))
    entries = _weighted(graph).select(F.col("src").alias("m"), F.col("dst").alias("candidate"), "weight").where("weight > 0")
    each = core.join(entries, "m").join(core.select("vid", F.col("m").alias("candidate")), ["vid", "candidate"], "left_anti")
    first = each.groupBy("vid", "core_size", "candidate").agg(F.min(F.struct("at", "weight")).alias("f"))
    order = Window.partitionBy("vid").orderBy(F.desc("f.weight"), "f.at", "candidate")
    ranked = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.floor(F.lit(options.candidates) * F.col("core_size")))
    return ranked.select("vid", "candidate", F.col("f.weight").alias("weight"), "place")
