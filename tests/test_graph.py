import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.minhash import is_prime, signature
from weftgraph.operators import cliques, focus, matching, partitioning, tasks, triangles
from weftgraph.operators.components import connected_components
from weftgraph.operators.graph import Graph, from_adjacency, normalise
from weftgraph.operators.pregel import pregel
from weftgraph.sources import adjacency

from . import sample


def graph_of(spark, edges, n, attrs=None, weights=None):
    vertices = spark.createDataFrame([(v, "abcd"[v % 4], (attrs or {}).get(v, ["x"])) for v in range(n)], "vid long, label string, attrs array<string>")
    rows = [(*e, float((weights or {}).get(e, 1.0))) for e in edges]
    return Graph(vertices, spark.createDataFrame(rows, "src long, dst long, weight double"))


def random_edges(seed, n, p):
    rng = random.Random(seed)
    return [e for e in itertools.combinations(range(n), 2) if rng.random() < p]


def sample_graph(spark):
    vertices = spark.createDataFrame(list(sample.LABELS.items()), "vid long, label string")
    return Graph(vertices, spark.createDataFrame(sample.EDGES, "src long, dst long"))


@pytest.mark.parametrize("kind", adjacency.FORMATS)
def test_formats_round_trip(spark, tmp_path, kind):
    source, target = tmp_path / "raw.adj", tmp_path / "parts"
    source.write_text("\n".join(["", *sample.raw_lines(kind), "   ", "junk line"]))
    raw = adjacency.read_raw(spark, str(source), kind)
    assert raw.count() == 15
    parts = partitioning.hash_parts(raw, 3)
    adjacency.write_partitioned(raw, parts, kind, str(target))
    back = adjacency.read_partitioned(spark, str(target), kind)
    assert {r.vid: r.part_id for r in back.collect()} == {v: v % 3 for v in sample.LABELS}
    assert {r.vid: r.adj for r in back.collect()} == {r.vid: r.adj for r in raw.collect()}
    assert set(map(tuple, from_adjacency(back).edges.select("src", "dst").collect())) == set(sample.EDGES)
    with pytest.raises(Exception):
        adjacency.write_partitioned(raw, parts, kind, str(target), force=False)


def test_attributes_of_partitioned_text(spark, tmp_path):
    path = tmp_path / "a"
    path.write_text("1 0\tB2 A1;0 A1\t2 1 \n-4 1\t\t")
    rows = {r.vid: r for r in adjacency.read_partitioned(spark, str(path), "attr").collect()}
    assert rows[1].attrs == ["A1", "B2"] and rows[1].adj == [2] and rows[-4].attrs == [] and rows[-4].adj == []


def test_normalise(spark):
    pairs = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (None, 1), (1, 5)], "src long, dst long")
    assert sorted(map(tuple, normalise(pairs).collect())) == [(1, 2), (1, 5)]


def test_sample(spark):
    g = sample_graph(spark)
    assert triangles.count_by_lists(g).first()[0] == triangles.count_by_joins(g).first()[0] == 12
    assert cliques.max_clique(g).first()[0] == 3
    assert {tuple(r) for r in triangles.clique_levels(g).collect()} == {(1, 15), (2, 27), (3, 12)}
    assert matching.count(g).first()[0] == 7
    rows = matching.match(g, matching.LABELS, matching.EDGES).collect()
    assert {(r.a, r.b1, r.c, r.b2, r.d) for r in rows} == sample.MATCHES
    assert tasks.triangle_program(g.greater()).agg(F.sum("triangles")).first()[0] == 12


@pytest.mark.parametrize(("seed", "n", "p"), [(1, 14, 0.5), (2, 24, 0.3), (3, 9, 1.0), (4, 8, 0.0)])
def test_counts_on_random_graphs(spark, seed, n, p):
    edges = random_edges(seed, n, p)
    g, have = graph_of(spark, edges, n), set(edges)
    cliques_of = {k: [c for c in itertools.combinations(range(n), k) if all(e in have for e in itertools.combinations(c, 2))] for k in (3, 4)}
    assert triangles.count_by_lists(g).first()[0] == len(cliques_of[3])
    assert triangles.four_cliques(g).first()[0] == len(cliques_of[4])
    per = {v: sum(v in t for t in cliques_of[3]) for v in range(n)}
    assert {r.vid: r.triangles for r in triangles.per_vertex(g).collect()} == {v: c for v, c in per.items() if c}
    sizes = {r["size"]: r.cliques for r in triangles.clique_levels(g).collect()}
    assert cliques.max_clique(g).first()[0] == max(sizes)
    label = "abcd"
    near = {v: {w for e in edges for w in e if v in e and w != v} for v in range(n)}
    want = sum(1 for a in range(n) if label[a % 4] == "a" for b1 in near[a] if label[b1 % 4] == "b" for c in near[a] & near[b1] if label[c % 4] == "c" for b2 in near[c] - {b1} if label[b2 % 4] == "b" for d in near[b2] if label[d % 4] == "d")
    assert matching.count(g).first()[0] == want


def plain_communities(near, attrs, k):
    """A single-threaded statement of the community search, by recursion over sets."""

    def coloured(nodes):
        classes = []
        for v in sorted(nodes, key=lambda v: (-len(near[v] & nodes), v)):
            for c in classes:
                if not c & near[v]:
                    c.add(v)
                    break
            else:
                classes.append({v})
        return [(v, i + 1) for i, c in enumerate(classes) for v in sorted(c)]

    found = set()
    for seed in near:
        later = {w for w in near[seed] if w > seed}
        if len(near[seed]) <= 1 or len(later) < k - 1 or not attrs[seed]:
            continue
        state = {"bound": 0, "common": set(attrs[seed]), "best": ()}

        def visit(nodes, chain):
            queue, left = coloured(nodes), set(nodes)
            while queue and len(chain) + queue[-1][1] > state["bound"]:
                v = queue.pop()[0]
                left.discard(v)
                shared = state["common"] & set(attrs[v])
                state["common"] = shared or state["common"]
                if left & near[v] and shared:
                    visit(left & near[v], [*chain, v])
                elif len(chain) + 1 > state["bound"]:
                    state["bound"] = len(chain) + 1
                    whole = [*chain, v] if shared else chain
                    if len(whole) >= k:
                        state["best"] = tuple(sorted(whole))
                elif len(chain) + 1 < state["bound"]:
                    state["bound"] += 1

        visit(later, [seed])
        if state["best"]:
            found.add(state["best"])
    return found


@pytest.mark.parametrize("seed", [5, 6])
def test_communities_match_a_plain_model(spark, seed):
    rng, n = random.Random(seed), 18
    edges = random_edges(seed, n, 0.45)
    attrs = {v: sorted(rng.sample("pqrst", rng.randint(0, 3))) for v in range(n)}
    near = {v: {w for e in edges for w in e if v in e and w != v} for v in range(n)}
    g = graph_of(spark, edges, n, attrs)
    for k in (2, 3):
        got = {tuple(r.members) for r in cliques.communities(g, k).collect()}
        assert got == plain_communities(near, attrs, k)


def test_focused_clusters(spark):
    """Two tight groups of four joined by a light edge: each is found from its core."""
    groups = [list(itertools.combinations(range(a, a + 4), 2)) for a in (0, 4)]
    edges = [*groups[0], *groups[1], (3, 4)]
    g = graph_of(spark, edges, 8, weights={(3, 4): 0.1})
    found = focus.clusters(g, focus.Focus(min_weight=1.0, min_core=3, min_result=3, diff_ratio=0.001, max_rounds=5, candidates=3), dedupe=True)
    assert {tuple(sorted(r.members)) for r in found.collect()} == {(0, 1, 2, 3), (4, 5, 6, 7)}
    assert [tuple(r) for r in focus.size_histogram(found).collect()] == [(4, 2)]


def test_components_and_pregel(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (20, 21)]
    df = spark.createDataFrame(edges, "src long, dst long")
    found = {r.vid: r.component for r in connected_components(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 20: 20, 21: 20}
    assert connected_components(df.where("src < 0")).count() == 0
    sym = df.union(df.select("dst", "src"))
    state = sym.select(F.col("src").alias("vid"), F.col("src").alias("value"), F.lit(True).alias("active")).distinct()
    done = pregel(state, sym, lambda v: v, F.min, lambda old, new: F.least(old, new))
    assert {r.vid: r.value for r in done.collect()} == found


def test_partitioning(spark, tmp_path):
    n = 40
    edges = random_edges(9, n, 0.1)
    g = graph_of(spark, edges, n)
    options = partitioning.Voronoi(rate=0.05, max_hop=4, max_cell=12, max_rate=0.5)
    colors = {r.vid: r.color for r in partitioning.blocks(g, options).collect()}
    assert set(colors) == set(range(n)) and None not in colors.values()
    parts = partitioning.block_parts(g, 4, options)
    assert {r.part_id for r in parts.collect()} <= set(range(4)) and parts.count() == n
    cut = partitioning.cut_statistics(g, partitioning.hash_parts(g.vertices, 4)).first()
    crossing = [e for e in edges if e[0] % 4 != e[1] % 4]
    assert (cut.cross_edges, cut.edges, cut.boundary_vertices, cut.vertices) == (len(crossing), len(edges), len({v for e in crossing for v in e}), n)
    source = tmp_path / "raw.adj"
    source.write_text("\n".join(sample.raw_lines("label")))
    for mode in ("label_hash", "label_bdg"):
        stats = partitioning.partition(spark, mode, str(source), str(tmp_path / mode), 3, options=options).first()
        assert (stats.edges, stats.vertices) == (27, 15)
        assert adjacency.read_partitioned(spark, str(tmp_path / mode), "label").count() == 15
    with pytest.raises(ValueError):
        partitioning.partition(spark, "label_other", str(source), str(tmp_path / "x"), 3)


def test_negative_ids_and_signatures(spark):
    rows = spark.createDataFrame([(-7,), (7,), (8,)], "vid long")
    assert {r.vid: r.part_id for r in partitioning.hash_parts(rows, 4).collect()} == {-7: 3, 7: 3, 8: 0}
    assert [n for n in range(30) if is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    lists = spark.createDataFrame([([3, 1, 2],), ([2, 3, 1],)], "ids array<long>")
    a, b = lists.select(signature(F.col("ids"), 4, 100).alias("s")).collect()
    assert a == b and len(a.s) == 4
