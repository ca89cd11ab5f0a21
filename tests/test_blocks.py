import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import blocks, cliques, matching, triangles
from weftgraph.sources import adjacency

from .test_graph import graph_of, random_edges


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    return {(a, b): sorted(near[a] & near[b]) for a, b in edges if near.get(b, set()) & near[a]}


def test_lists_are_packed_and_unpacked():
    lists = [[-(1 << 62), -5, 7, 1 << 62], [], [3], [1, 2, 300], list(range(1000)), [0, 70_000]]
    for some in (lists, lists[1:4], lists[3:], [[]]):
        values = np.array([v for x in some for v in x], np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in some])))
        first, width, steps = blocks.packed(values, offsets)
        out, start = blocks.unpacked(first, np.diff(offsets), np.full(len(some), width), steps)
        assert [out[a:b].tolist() for a, b in zip(start, start[1:])] == some
    a, b = (blocks.packed(np.array(x), np.array([0, len(x)])) for x in ([1, 2], [5, 1 << 20]))
    out, _ = blocks.unpacked(np.array([1, 5]), np.array([2, 2]), np.array([a[1], b[1]]), pa.concat_arrays([a[2], b[2]]))
    assert out.tolist() == [1, 2, 5, 1 << 20]


@pytest.mark.parametrize("layout,scale", [((1, 1), 1), ((4, 3), 1), ((3, 2), 1 << 55)])
def test_wedges_close_whatever_the_blocks(spark, monkeypatch, layout, scale):
    edges = random_edges(5, 40, 0.3)
    far = [(a * scale - 20 * scale, b * scale - 20 * scale) for a, b in edges]
    monkeypatch.setattr(blocks, "layout", lambda n, cores: layout)
    monkeypatch.setattr(blocks, "WEDGES", 50)
    monkeypatch.setattr(blocks, "PLACES", 200)
    df = spark.createDataFrame(far, "src long, dst long")
    lists = df.groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list("dst")).alias("gt"))
    want = brute(far)
    found = [((r.src, r.dst), r.both) for r in blocks.closing(df, lists).collect()]
    assert len(found) == len(want) and dict(found) == want
    nets = {r.seed: r for r in blocks.nets(df, lists).collect()}
    assert set(nets) == {a for a, _ in want}
    for seed, r in nets.items():
        ends = iter(r.end)
        assert {m: list(itertools.islice(ends, n)) for m, n in zip(r.mid, r.n)} == {b: both for (a, b), both in want.items() if a == seed}


def test_lists_are_not_joined_edge_by_edge(spark):
    """F4, F8 to F13: a list does not move once for each edge that leads to it."""
    g = graph_of(spark, random_edges(3, 12, 0.5), 12)
    for found in (triangles._closing(g), triangles.count_by_joins(g), triangles.by_smallest(g), triangles.per_vertex(g), triangles.four_cliques(g), triangles.clique_levels(g)):
        assert "array_intersect" not in plan(found) and "Wedge" not in plan(found)
    assert plan(triangles.count_by_joins(g)).count("Join") == 0
    assert "array_intersect" not in plan(cliques.communities(g, 3)) + plan(matching.counts_by_a(g))


def test_levels_of_a_large_clique_are_counted_not_listed(spark):
    """2^40 cliques, which no table of a level holds."""
    n = 40
    g = graph_of(spark, list(itertools.combinations(range(n), 2)), n)
    assert {r["size"]: r.cliques for r in triangles.clique_levels(g).collect()} == {k: math.comb(n, k) for k in range(1, n + 1)}
    assert {r["size"]: r.cliques for r in triangles.clique_levels(g, 3).collect()} == {k: math.comb(n, k) for k in (1, 2, 3)}
    assert triangles.four_cliques(g).first()[0] == math.comb(n, 4) and cliques.max_clique(g).first()[0] == n


def test_cliques_of_small_graphs(spark):
    for edges, n, most in (([], 0, 0), ([], 3, 1), ([(0, 1), (1, 2)], 3, 2)):
        g = graph_of(spark, edges, n)
        assert cliques.max_clique(g).first()[0] == most
        assert max((r["size"] for r in triangles.clique_levels(g).collect() if r.cliques), default=0) == most
        assert triangles.four_cliques(g).first()[0] == 0 == triangles.count_by_joins(g).first()[0]


def test_pattern_and_attributes_by_blocks(spark, monkeypatch):
    """F3, F8, F19: the same communities, triangles and counts whatever the blocks."""
    g = graph_of(spark, random_edges(9, 30, 0.4), 30)
    told = []
    for layout in ((1, 1), (4, 2)):
        monkeypatch.setattr(blocks, "layout", lambda n, cores, layout=layout: layout)
        told.append([sorted(map(str, df.collect())) for df in (cliques.communities(g, 3), cliques.common_attribute_triangles(g), matching.counts_by_a(g))])
    assert told[0] == told[1] and all(told[0])


def test_a_partition_is_written_by_several_tasks(spark, tmp_path):
    """not by one, which holds all its lines."""
    rows = spark.range(400).selectExpr("id AS vid", "array(id + 1) AS adj")
    parts = rows.selectExpr("vid", "0 AS part_id")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # which joins the few rows of a test
    spark.conf.set(setting, "false")
    try:
        adjacency.write_partitioned(rows, parts, "normal", str(tmp_path / "p"))
    finally:
        spark.conf.unset(setting)
    files = list((tmp_path / "p" / "part_id=0").glob("part-*"))
    assert 1 < len(files) <= adjacency.FILES
    assert adjacency.read_partitioned(spark, str(tmp_path / "p"), "normal").count() == 400
