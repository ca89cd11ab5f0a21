import itertools
from collections import Counter

from pyspark.sql import functions as F

from weftgraph.operators import focus, matching
from weftgraph.plans import catalog

from .test_graph import graph_of, random_edges


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_focused_clusters_cover_the_whole_graph(spark, monkeypatch):
    """Cores by edges of weight 2 with light edges between them: light edges count in the cut and carry growth."""
    edges = [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 8), 2), (3, 4), (7, 8), (8, 9)]
    g = graph_of(spark, edges, 10, weights=dict.fromkeys([e for e in edges if e[1] < 4 or 4 <= e[0] < e[1] < 8], 2.0))
    monkeypatch.setattr(catalog, "graph", lambda spark, sf_dir: g)
    found = catalog.QUERIES["fco_clusters"](spark, "")
    assert found.count() > 0 and rows(found) == rows(focus.clusters(g, catalog.FOCUS))
    light = focus.clusters(g.__class__(g.vertices, g.edges.where(F.col("weight") >= 2)), catalog.FOCUS)
    assert rows(found) != rows(light)


def test_components_levels_and_matches_cover_the_whole_graph(spark, monkeypatch):
    """Against brute force on a graph whose edges all have weight 1, but for one."""
    n, edges = 16, random_edges(11, 13, 0.45)
    g = graph_of(spark, edges, n, weights={edges[0]: 2.0})
    monkeypatch.setattr(catalog, "graph", lambda spark, sf_dir: g)
    near = {v: {w for e in edges for w in e if v in e and w != v} for v in range(n)}
    component = {v: v for v in range(n)}
    for _ in range(n):
        component = {v: min([component[v], *(component[w] for w in near[v])]) for v in range(n)}
    assert {r.vid: r.component for r in catalog.QUERIES["cc_hashmin"](spark, "").collect()} == component
    levels = {k: sum(all(b in near[a] for a, b in itertools.combinations(c, 2)) for c in itertools.combinations(range(n), k)) for k in range(1, n)}
    assert {r["size"]: r.cliques for r in catalog.QUERIES["mc_levels"](spark, "").collect()} == {k: c for k, c in levels.items() if c}
    of = {x: [v for v in range(n) if "abcd"[v % 4] == x] for x in "abcd"}
    want = {(a, b, c, e, d) for a in of["a"] for b in near[a] for c in near[a] & near[b] for e in near[c] - {b} for d in near[e] if b in of["b"] and c in of["c"] and e in of["b"] and d in of["d"]}
    assert want and sorted((r.a, r.b1, r.c, r.b2, r.d) for r in matching.match(g, matching.LABELS, matching.EDGES).collect()) == sorted(want)
    by_ends = Counter((m[0], m[4]) for m in want)
    assert {(r.a, r.d): r.matches for r in catalog.QUERIES["gm_match"](spark, "").collect()} == by_ends
    by_a = Counter(m[0] for m in want)
    assert {r.a: r.matches for r in catalog.QUERIES["gm_matches_by_a"](spark, "").collect()} == {r.a: r.matches for r in catalog.QUERIES["gm_tasks"](spark, "").collect()} == by_a
    assert catalog.QUERIES["mc_tasks"](spark, "").first()[0] == catalog.QUERIES["mc_bnb"](spark, "").first()[0] == max(k for k, c in levels.items() if c)


def test_matches_by_both_ends_are_counted_not_made(spark, monkeypatch):
    """no table of matches or of parts of them; whatever the groups, and where no a, b or d has any."""
    for n, edges in ((40, random_edges(4, 40, 0.4)), (8, [(0, 1), (0, 2), (1, 2), (2, 5)]), (8, [(0, 1), (0, 2), (1, 2), (2, 5), (3, 5)]), (4, [(0, 1)])):
        g = graph_of(spark, edges, n)
        want = Counter((m.a, m.d) for m in matching.match(g, matching.LABELS, matching.EDGES).collect())
        for most, least in ((1_000_000, 50_000), (5, 20)):
            monkeypatch.setattr(matching, "MATCHES", most)
            monkeypatch.setattr("weftgraph.operators.tasks.LEAST_PULLS", least)
            found = catalog.QUERIES["gm_match"].on(g)
            assert "HashAggregate" not in str(found._jdf.queryExecution().executedPlan()).split("MapInArrow")[0]
            rows = found.collect()
            assert len(rows) == len(want) and {(r.a, r.d): r.matches for r in rows} == want
