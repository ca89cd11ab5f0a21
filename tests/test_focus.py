"""Focused clusters against a plain model that sums over the whole cluster for every question."""

import random
from fractions import Fraction

import pytest

from weftgraph.operators import focus

from .test_graph import graph_of, random_edges

#: Weights of the 27 edges of the sample graph, in the order of sample.EDGES.
SAMPLE_WEIGHTS = ".90 .30 .90 .95 .97 .61 .92 .24 .16 .57 .43 .88 .94 .21 .13 .39 .97 .91 .89 .95 .46 .99 .86 .93 .37 .94 .29"


def plain_clusters(weights, o):
    """weights: (a, b) -> weight of each edge. The members of each emitted cluster in order, its outliers and phi."""
    near = {}
    for (a, b), w in weights.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = Fraction(w)
    near = {v: dict(sorted(n.items())) for v, n in sorted(near.items())}

    def conductance(s, weighted=True):
        cut = sum((w if weighted else 1) for v in s for u, w in near[v].items() if w >= 0 and u not in s)
        inner = sum((w if weighted else 1) for v in s for u, w in near[v].items() if w >= 0 and u in s and v < u)
        return Fraction(cut) / inner if inner else Fraction(-1)

    def outside(order, s, most):
        first = {}
        for v in order:
            for u, w in near[v].items():
                if w > 0 and u not in s:
                    first.setdefault(u, w)
        return sorted(first, key=lambda u: -first[u])[: int(most)] if len(first) > most else list(first)

    def same(a, b):
        return b / a <= 1 + Fraction(o.diff_ratio) if a else b < 0

    found = {}
    for seed in near:
        core = [seed, *[u for u, w in near[seed].items() if w >= Fraction(o.min_weight)]]
        if len(core) < o.min_core:
            continue
        members, outlier, rounds, start = list(core), set(), 0, None
        candidates = outside(core, set(core), o.candidates * len(core))
        emitted = False
        while True:
            s = set(members)
            phi = conductance(s)
            if phi < 0:
                break
            start = phi if start is None else start
            drops = [(conductance(s | {c}) - phi, c) for c in candidates]
            shapes = [(conductance(s | {c}, False) - conductance(s, False), c) for c in candidates]
            best, shape = min(drops, default=(0, None)), min(shapes, default=(0, None))
            drop = min(best[0], 0)
            if not same(phi + drop, phi):
                if shape[0] < 0:
                    outlier.add(shape[1])
                if best[0] < 0:
                    members.append(best[1])
                    candidates = outside(sorted(members), set(members), o.candidates * len(members))
                    continue
            gone, again = False, True
            while again:
                again = False
                for v in sorted(s):
                    new = conductance(s - {v})
                    if 0 <= new <= phi:
                        s.discard(v)
                        phi, gone, again = new, True, True
            if gone:
                members = [v for v in members if v in s]
                outlier -= s
                candidates = outside(sorted(members), s, o.candidates * len(members))
            if not same(phi, start) and rounds < o.max_rounds:
                start, rounds = phi, rounds + 1
                continue
            emitted = len(members) >= o.min_result
            break
        if emitted:
            found.setdefault(tuple(members), (tuple(sorted(outlier)), phi))
    return found


def rows(found):
    return {tuple(r.members): (tuple(r.outlier), r.phi) for r in found.collect()}


def agree(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(float(want[k][1]), rel=1e-12) for k in want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_both_ways_match_a_plain_model(spark, seed):
    """Broadcast lists, and lists pulled in the task model."""
    rng, n = random.Random(seed), 22
    edges = random_edges(seed, n, 0.25)
    weights = {e: rng.choice((-0.5, 0.0, 0.125, 0.5, 0.5, 0.75, 1.0, 1.0)) for e in edges}
    g = graph_of(spark, edges, n, weights=weights)
    for options in (focus.Focus(0.75, 3, 2, 0.001, 10, 1.0), focus.Focus(1.0, 2, 0, 0.05, 2, 3.0)):
        want = plain_clusters(weights, options)
        assert want
        agree(rows(focus.clusters(g, options)), want)
        if seed == 1:
            agree(rows(focus.clusters(g, options, broadcast_bytes=0)), want)


def test_weights_that_are_no_powers_of_two(spark):
    rng, n = random.Random(4), 40
    edges = random_edges(4, n, 0.2)
    weights = {e: rng.randint(1, 100) / 100 for e in edges}
    options = focus.Focus(0.92, 3, 5, 0.001, 10, 3.0)
    agree(rows(focus.clusters(graph_of(spark, edges, n, weights=weights), options)), plain_clusters(weights, options))


def test_the_sample_graph(spark):
    """Known answers: six clusters, from the cores 2, 3, 5 and 11, 12, 15."""
    from . import sample

    weights = dict(zip(sample.EDGES, map(float, SAMPLE_WEIGHTS.split()), strict=True))
    found = focus.clusters(graph_of(spark, sample.EDGES, 16, weights=weights), focus.Focus(0.92, 3, 5, 0.001, 10, 3.0))
    got = rows(found)
    assert set(got) == {(2, 3, 5, 1, 4), (3, 2, 5, 1, 4), (5, 2, 3, 1, 4), (11, 12, 15, 13, 14), (12, 11, 15, 13, 14), (15, 11, 12, 13, 14)}
    for members, (outlier, phi) in got.items():
        assert (outlier, round(phi, 8)) == (((1, 4), 0.14185639) if 2 in members else ((14,), 0.10880829))
    assert [tuple(r) for r in focus.size_histogram(found).collect()] == [(5, 6)]


def test_no_cores_and_no_edges(spark):
    assert focus.clusters(graph_of(spark, [(0, 1)], 2), focus.Focus(5.0, 2)).count() == 0
    empty = graph_of(spark, [(0, 1)], 2)
    empty = type(empty)(empty.vertices, empty.edges.limit(0))
    assert focus.clusters(empty, focus.Focus(1.0, 2)).count() == 0


def test_cores_and_scores_move_no_neighbourhoods(spark):
    """F21 to F24: cores come from heavy edges alone, and lists are made once, only where clusters are pulled."""
    edges = random_edges(21, 16, 0.5)
    g = graph_of(spark, edges, 16, weights={e: float(i % 5 - 1) for i, e in enumerate(edges)})
    for least in (0, 1, 2, 4):
        options = focus.Focus(min_weight=2.0, min_core=least, candidates=2.0)
        want = {r.vid: r.core for r in focus.cores(focus.neighbourhoods(g), options).collect()}
        assert {r.vid: r.core for r in focus.heavy_cores(g, options).collect()} == want and want
        for found in (focus.core_conductance(g, options), focus.first_candidates(g, options)):
            assert "total" not in found._jdf.queryExecution().executedPlan().toString()
            assert {r.vid for r in found.collect()} <= set(want)
