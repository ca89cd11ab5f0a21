import sys

import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.operators import tasks
from weftgraph.operators.subgraph import Aggregator, Subgraph
from weftgraph.sources import adjacency, config

from . import sample
from .test_graph import graph_of


def test_pattern_in_the_task_model(spark, tmp_path):
    path = tmp_path / "l.adj"
    path.write_text("\n".join(sample.raw_lines("label")))
    vertices = adjacency.read_raw(spark, str(path), "label").withColumnRenamed("adj", "near")
    rows = tasks.match_program(vertices).collect()
    assert sum(r.matches for r in rows) == 7
    by = {}
    for a, *_ in sample.MATCHES:
        by[a] = by.get(a, 0) + 1
    assert {r.task_id: r.matches for r in rows if r.matches} == by


def test_rounds_and_interim_aggregates(spark):
    """Tasks walk up a chain of vertices for as many rounds as their id, and see what finished before."""
    vertices = spark.range(10).select(F.col("id").alias("vid"), (F.col("id") + 1).alias("next"))
    seeds = spark.range(1, 5).select(F.col("id").alias("task_id"), F.array("id").alias("pull"), F.lit(0).alias("steps"), F.lit(-1).alias("seen"))

    def compute(state, front, interim):
        steps = state["steps"] + 1
        going = steps < state["task_id"]
        return {**state, "steps": steps, "seen": -1 if interim is None else interim}, [front[0]["next"]], going

    got = {r.task_id: (r.steps, r.seen) for r in tasks.run(seeds, vertices, compute, aggregate=F.coalesce(F.sum("steps"), F.lit(0)).cast("int")).collect()}
    assert got == {1: (1, -1), 2: (2, 1), 3: (3, 3), 4: (4, 6)}


def test_one_frontier_at_a_time(spark):
    """What Python holds during compute does not grow with the number of tasks in a partition."""
    near = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct((i + F.col("id") * 1000).alias("id"), F.lit("b").alias("label")))
    vertices = spark.range(200).select(F.col("id").alias("vid"), near.alias("near"))

    def compute(state, front, interim):
        met = [f["vid"] for f in front] == list(range(200)) and all(len(f["near"]) == 100 for f in front)
        return {**state, "met": met, "blocks": sys.getallocatedblocks()}, [], False

    def most(n):
        seeds = spark.range(n).select(F.col("id").alias("task_id"), F.sequence(F.lit(0), F.lit(199)).cast("array<bigint>").alias("pull"), F.lit(False).alias("met"), F.lit(0).cast("long").alias("blocks"))
        rows = tasks.run(seeds, vertices, compute).collect()
        assert sorted(r.task_id for r in rows) == list(range(n)) and all(r.met for r in rows)
        return max(r.blocks for r in rows)

    assert most(48) < 1.4 * most(1)


def test_states_of_all_kinds_and_pulls_of_unknown_or_repeated_vertices(spark):
    vertices = spark.createDataFrame([(1, "x"), (2, None)], "vid long, name string")
    seeds = spark.createDataFrame([(7, [2, 9, 1, 2], None, {"k": [1.5, None]}), (8, [], "é", None), (9, None, "", {"k": []})], "task_id long, pull array<long>, text string, s struct<k:array<double>>")

    def compute(state, front, interim):
        if state["task_id"] == 7 and len(front) == 3:
            return {**state, "text": ",".join(str(f["name"]) for f in front)}, [1], True
        return {**state, "text": f"{state['text']}|{len(front)}"}, [], False

    got = {r.task_id: (r.text, r.s and r.s.k) for r in tasks.run(seeds, vertices, compute).collect()}
    assert got == {7: ("None,x,None|1", [1.5, None]), 8: ("é|0", None), 9: ("|0", [])}


def test_plain_values_of_nested_columns():
    kind = pa.list_(pa.struct([("id", pa.int64()), ("w", pa.float64()), ("s", pa.string()), ("l", pa.list_(pa.int32()))]))
    one = {"id": 1, "w": 0.5, "s": "é", "l": [1, None]}
    column = pa.array([[one, None], None, [], [{**one, "id": None, "l": None}, {**one, "w": float("inf"), "s": None, "l": []}]], kind)
    for low in range(5):
        for n in range(5 - low):
            part = column.slice(low, n)
            assert tasks.plain(part) == part.to_pylist()
            part = pa.array([{"x": v, "b": True} for v in column.to_pylist()] + [None]).slice(low, n)
            assert tasks.plain(part) == part.to_pylist()


def test_subgraph():
    g = Subgraph()
    for v in (3, 1, 2):
        g.add_node(v, attr=str(v))
    g.add_edge(1, 2)
    g.add_edge(1, 2)
    g.add_edge(1, 3)
    assert [n["id"] for n in g.nodes()] == [3, 1, 2] and g.get_node(1)["neighbours"] == [2, 3] and g.has_node(2)
    assert g.set_node(2, "new")["neighbours"] == [1] and g.get_node(2)["attr"] == "new"
    g.add_neighbour(2, 9)
    g.add_neighbour(2, 9)
    assert g.get_node(2)["neighbours"] == [1, 9] and not g.has_node(9)
    again = Subgraph.of(g.rows())
    again.del_edge(1, 3)
    again.del_node(2)
    again.del_node(9)
    assert [n["neighbours"] for n in again.nodes()] == [[], []] and len(again) == 2 and len(g) == 3


class Union(Aggregator):
    def initial(self):
        return set()

    def step(self, partial, state):
        return partial | {state["steps"]}

    def merge(self, a, b):
        return a | b


def test_aggregator(spark):
    df = spark.range(7).select((F.col("id") % 3).alias("steps")).repartition(3)
    assert Union().over(df) == {0, 1, 2}


def test_options(tmp_path):
    path = tmp_path / "job.ini"
    path.write_text("[PATH]\nHDFS_INPUT_PATH = /in ; where\nFORCE_WRITE = false\n[COMPUTING]\nNUM_COMP_THREAD = 6\nCACHE_SIZE = 10\n")
    options = config.load(str(path))
    assert (options.input, options.force, options.threads, options.other["cache_size"]) == ("/in", False, 6, "10")
    assert options.spark_conf() == {"spark.executor.cores": "6"}


def test_a_vertex_comes_once_to_a_group(spark, monkeypatch):
    """F15 to F17: not once for each task that pulls it."""
    lists = graph_of(spark, [(a, b) for a in range(12) for b in range(a + 1, 12)], 12).greater()
    seeds = lists.select(F.col("vid").alias("task_id"), F.col("gt").alias("pull"))
    assert tasks.frontier(seeds, lists).where("task_id IS NULL").count() == 10  # of 66 pulls: 1 to 10, which have lists
    monkeypatch.setattr(tasks, "LEAST_PULLS", 20)
    for cached in (1, 1 << 24):
        monkeypatch.setattr(tasks, "CACHE_BYTES", cached)
        assert tasks.triangle_program(lists).agg(F.sum("triangles")).first()[0] == 220
        assert tasks.clique_program(lists).agg(F.max("size")).first()[0] == 12
