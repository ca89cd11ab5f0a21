"""Every graph query of the library by name, and the SQL that states the same result.

The graph is that of parts bought in one order (see sources.tables), unless a query says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.minhash import signature
from ..functions.shared import scratch_path
from ..operators import cliques, focus, matching, partitioning, pregel, tasks, triangles
from ..operators.graph import Graph
from ..sources import adjacency, tables

Query = Callable[[SparkSession, str], DataFrame]
PARTS = 8
#: Edges of at least this many shared orders carry weight in the focused-cluster queries.
FOCUS = focus.Focus(min_weight=2.0, min_core=4, min_result=3, diff_ratio=0.001, max_rounds=10, candidates=3.0)
VORONOI = partitioning.Voronoi(rate=0.01, max_hop=10, max_cell=600, max_rate=0.2)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return tables.parts_bought_together(spark, sf_dir).stored()


class GraphQuery:
    """A query of the tables by way of their graph; on() answers it on a graph that is there."""

    def __init__(self, on: Callable[[Graph], DataFrame]):
        self.on = on

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.on(graph(spark, sf_dir))


_on_graph = GraphQuery


def _degree_stats(g: Graph) -> DataFrame:
    d = g.degrees()
    return d.agg(F.count("*").alias("vertices"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.sum("degree").alias("total"))


def _hash_sizes(g: Graph) -> DataFrame:
    return partitioning.hash_parts(g.vertices, PARTS).groupBy("part_id").agg(F.count("*").alias("vertices"))


def _by_modulus(g: Graph) -> DataFrame:
    return g.vertices.select("vid", F.pmod(F.col("vid"), F.lit(37)).alias("color"))


def _block_info(g: Graph) -> DataFrame:
    info = partitioning.block_info(g, _by_modulus(g))
    return info.select("color", "size", F.size("neighbours").cast("long").alias("n_neighbours"))


def _nation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.components import connected_components

    found = connected_components(tables.customers_by_nation(spark, sf_dir))
    return found.groupBy("component").agg(F.count("*").alias("vertices"))


def _pregel_reach(g: Graph) -> DataFrame:
    """Hops from the smallest part, by messages."""
    least = g.vertices.agg(F.min("vid")).first()[0]
    start = g.vertices.select("vid", F.when(F.col("vid") == least, 0).cast("int").alias("value"), (F.col("vid") == least).alias("active"))
    done = pregel.pregel(start, g.sym().select("src", "dst"), lambda v: v + 1, F.min, lambda old, new: F.least(old, new))
    return done.groupBy(F.coalesce("value", F.lit(-1)).alias("hops")).agg(F.count("*").alias("vertices"))


def _tc_tasks(g: Graph) -> DataFrame:
    return tasks.triangle_program(g.greater()).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))


def _voronoi_check(g: Graph) -> DataFrame:
    colors = partitioning.blocks(g, VORONOI)
    return colors.groupBy("color").agg(F.count("*").alias("size"))


def _bdg_assign(g: Graph) -> DataFrame:
    return partitioning.block_parts(g, PARTS, VORONOI).groupBy("part_id").agg(F.count("*").alias("vertices"))


def _fco_seed_cores(g: Graph) -> DataFrame:
    return focus.cores(focus.neighbourhoods(g), FOCUS).select("vid", F.size("core").alias("core_size"))


def _cd_seeds(g: Graph) -> DataFrame:
    return cliques.community_seeds(g, 3).select("vid", F.size("gt").alias("candidates"), F.size("attrs").alias("attrs"))


def _minhash(g: Graph) -> DataFrame:
    signed = g.greater().select("vid", signature(F.col("gt"), 4, 1 << 20, seed=5).alias("s"))
    return signed.select("vid", *[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(4)])


def _near_labelled(g: Graph) -> DataFrame:
    """vid, label, near: the vertices as pattern tasks pull them."""
    pairs = matching.labelled(g).select(F.col("src").alias("_v"), F.struct(F.col("dst").alias("id"), F.col("dst_label").alias("label")).alias("n"))
    near = pairs.groupBy("_v").agg(F.sort_array(F.collect_list("n")).alias("near"))
    return g.vertices.select("vid", "label").join(near, F.col("vid") == F.col("_v")).drop("_v")


def _gm_tasks(g: Graph) -> DataFrame:
    return tasks.match_program(_near_labelled(g)).where("matches > 0").select(F.col("task_id").alias("a"), "matches")


def _as_text(g: Graph, kind: str) -> str:
    """The folder of the graph's raw text of a kind."""
    pairs = matching.labelled(g) if kind == "label" else g.sym()
    entry = {"label": F.struct(F.col("dst").alias("id"), F.col("dst_label").alias("label")), "multi_attr": F.struct(F.col("dst").alias("id"), F.col("weight").cast("double").alias("weight"))}.get(kind, F.col("dst"))
    lists = pairs.select(F.col("src").alias("_v"), entry.alias("n")).groupBy("_v").agg(F.sort_array(F.collect_list("n")).alias("adj"))
    path = scratch_path(g.edges.sparkSession, f"raw-{kind}")
    adjacency.raw_lines(g.vertices.join(lists, F.col("vid") == F.col("_v"), "left").withColumn("adj", F.coalesce("adj", F.array().cast(lists.schema["adj"].dataType))), kind).write.text(path)
    return path


def _told(found: DataFrame, kind: str, *by: str) -> DataFrame:
    """What a format carried, as sums: vertices, neighbours and their ids, and what else the kind has."""
    ids = F.col("adj") if kind in ("normal", "attr") else F.transform("adj", lambda x: x["id"])

    def sum_of(values):
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    extra = {
        "normal": F.lit(0).cast("long"),
        "label": F.ascii("label").cast("long") + sum_of(F.transform("adj", lambda x: F.ascii(x["label"]).cast("long"))) if kind == "label" else None,
        "attr": F.length(F.array_join("attrs", "")).cast("long") if "attr" in kind else None,
        "multi_attr": F.length(F.array_join("attrs", "")).cast("long") + sum_of(F.transform("adj", lambda x: x["weight"].cast("long"))) if kind == "multi_attr" else None,
    }[kind]
    rows = found.select(F.lit(kind).alias("kind"), *by, "vid", F.size("adj").cast("long").alias("n"), sum_of(ids).alias("s"), extra.alias("e"))
    return rows.groupBy("kind", *by).agg(F.count("*").alias("vertices"), F.sum("vid").alias("vid_sum"), F.sum("n").alias("neighbours"), F.sum("s").alias("id_sum"), F.sum("e").alias("extra_sum"))


def _formats_raw(g: Graph) -> DataFrame:
    """Each raw format written, loaded in blocks of bytes, and read back."""
    spark, out = g.edges.sparkSession, None
    for kind in adjacency.FORMATS:
        path = scratch_path(spark, f"loaded-{kind}")
        adjacency.load(spark, _as_text(g, kind), path, block_bytes=1 << 20)
        one = _told(adjacency.read_raw(spark, path, kind), kind)
        out = one if out is None else out.union(one)
    return out


def _formats_partitioned(g: Graph) -> DataFrame:
    """Each format partitioned by hash from its raw text, and read back from the partitioned text."""
    spark, out = g.edges.sparkSession, None
    for kind in adjacency.FORMATS:
        path = scratch_path(spark, f"parts-{kind}")
        partitioning.partition(spark, f"{kind.removeprefix('multi_')}_hash", _as_text(g, kind), path, PARTS, multi_attr=kind == "multi_attr")
        one = _told(adjacency.read_partitioned(spark, path, kind), kind, "part_id")
        out = one if out is None else out.union(one)
    return out


def _neighbour_parts(g: Graph) -> DataFrame:
    """Of the partitioned text's neighbour entries, how many lead from one partition to another."""
    spark = g.edges.sparkSession
    path = scratch_path(spark, "parts-exchange")
    partitioning.partition(spark, "normal_hash", _as_text(g, "normal"), path, PARTS)
    pair = F.split(F.trim(F.get(F.split("value", "\t"), F.lit(1))), " ")
    own = F.get(F.split(F.get(F.split("value", "\t"), F.lit(0)), " "), F.lit(1)).cast("int").alias("part_id")
    theirs = F.explode(F.transform(F.filter(pair, lambda x, i: i % 2 == 1), lambda x: x.cast("int"))).alias("near_part")
    return spark.read.text(path).select("value", own).select("part_id", theirs).groupBy("part_id", "near_part").agg(F.count("*").alias("entries"))


QUERIES: dict[str, Query] = {
    "degree_stats": _on_graph(_degree_stats),
    "edge_weights": _on_graph(lambda g: g.edges.groupBy("weight").agg(F.count("*").alias("edges"))),
    "tc_array": _on_graph(triangles.count_by_lists),
    "tc_join": _on_graph(triangles.count_by_joins),
    "tc_per_vertex": _on_graph(triangles.per_vertex),
    "tc_per_seed": _on_graph(triangles.by_smallest),
    "tc_tasks": _on_graph(_tc_tasks),
    "clustering": _on_graph(triangles.clustering),
    "k4_count": _on_graph(triangles.four_cliques),
    "mc_size": _on_graph(lambda g: triangles.clique_levels(g).agg(F.max("size").alias("max_clique"))),
    "mc_levels": _on_graph(triangles.clique_levels),
    "mc_tasks": _on_graph(lambda g: tasks.clique_program(g.greater()).agg(F.max("size").alias("max_clique"))),
    "mc_bnb": _on_graph(cliques.max_clique),
    "gm_count": _on_graph(matching.count),
    "gm_matches_by_a": _on_graph(matching.counts_by_a),
    "gm_match": _on_graph(matching.ends_of_matches),
    "gm_tasks": _on_graph(_gm_tasks),
    "label_nb_counts": _on_graph(matching.neighbour_labels),
    "cd_seeds": _on_graph(_cd_seeds),
    "cd_exact_triangles": _on_graph(cliques.common_attribute_triangles),
    "cd_heuristic": _on_graph(lambda g: cliques.communities(g, 3)),
    "fco_seed_cores": _on_graph(_fco_seed_cores),
    "phi_scores": _on_graph(lambda g: focus.core_conductance(g, FOCUS)),
    "fco_topk_candidates": _on_graph(lambda g: focus.first_candidates(g, FOCUS)),
    "fco_clusters": _on_graph(lambda g: focus.clusters(g, FOCUS)),
    "fco_sizes": _on_graph(lambda g: focus.size_histogram(focus.clusters(g, FOCUS))),
    "formats_raw": _on_graph(_formats_raw),
    "formats_partitioned": _on_graph(_formats_partitioned),
    "neighbour_parts": _on_graph(_neighbour_parts),
    "hash_partition_sizes": _on_graph(_hash_sizes),
    "hash_cut_stats": _on_graph(lambda g: partitioning.cut_statistics(g, partitioning.hash_parts(g.vertices, PARTS))),
    "cc_hashmin": _on_graph(partitioning.components),
    "cc_nations": _nation_components,
    "pregel_hops": _on_graph(_pregel_reach),
    "block_info": _on_graph(_block_info),
    "block_histogram": _on_graph(lambda g: partitioning.block_histogram(partitioning.block_info(g, _by_modulus(g)))),
    "voronoi_blocks": _on_graph(_voronoi_check),
    "bdg_assign": _on_graph(_bdg_assign),
    "minhash_signatures": _on_graph(_minhash),
}

_E = """e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(DISTINCT a.l_orderkey) AS weight FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL),
s AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
v AS (SELECT p_partkey AS vid, chr(CAST(97 + p_partkey % 4 AS INTEGER)) AS label, [p_brand, p_type, 'S' || CAST(p_size // 10 AS VARCHAR)] AS attrs FROM part)"""
_T = "t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst)"
_PV = "pv AS (SELECT vid, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS vid FROM t) GROUP BY vid)"
_GM = """l AS (SELECT s.src, s.dst, x.label AS ls, y.label AS ld FROM s JOIN v x ON x.vid = s.src JOIN v y ON y.vid = s.dst),
k AS (SELECT src AS b, count(*) AS k FROM l WHERE ls = 'b' AND ld = 'd' GROUP BY src),
cb AS (SELECT src AS c, dst AS b, coalesce(k, 0) AS k FROM l LEFT JOIN k ON k.b = l.dst WHERE ls = 'c' AND ld = 'b'),
tot AS (SELECT c, sum(k) AS t FROM cb GROUP BY c),
m AS (SELECT ab.src AS a, sum(tot.t - cb.k) AS matches FROM l ab JOIN l ac ON ab.src = ac.src AND ac.ls = 'a' AND ac.ld = 'c'
  JOIN cb ON cb.c = ac.dst AND cb.b = ab.dst JOIN tot ON tot.c = ac.dst WHERE ab.ls = 'a' AND ab.ld = 'b' GROUP BY ab.src)"""
_CORE = f"""h AS (SELECT src AS vid, dst AS m FROM s WHERE weight >= {FOCUS.min_weight}),
sz AS (SELECT vid, count(*) + 1 AS core_size FROM h GROUP BY vid HAVING count(*) + 1 >= {FOCUS.min_core}),
core AS (SELECT vid, core_size, m, row_number() OVER (PARTITION BY vid ORDER BY m) AS spot FROM h JOIN sz USING (vid) UNION ALL SELECT vid, core_size, vid, 0 FROM sz)"""


def _minhash_sql() -> str:
    import random

    from ..functions.minhash import is_prime

    rng = random.Random(5)
    prime = next(n for n in range(1 << 20, 1 << 21) if is_prime(n))
    pairs = [(rng.randrange(1, prime), rng.randrange(prime)) for _ in range(4)]
    columns = ", ".join(f"min((dst % {prime} * {a} + {b}) % {prime}) AS s{i}" for i, (a, b) in enumerate(pairs))
    return f"WITH {_E} SELECT src AS vid, {columns} FROM e GROUP BY src"


def _cliques_sql(result: str) -> str:
    return f"""WITH RECURSIVE {_E}, g AS (SELECT src, list(dst) AS gt FROM e GROUP BY src),
q(k, cand) AS (SELECT 1, gt FROM g UNION ALL SELECT q.k + 1, list_intersect(q.cand, coalesce(g.gt, []::BIGINT[]))
  FROM (SELECT k, cand, unnest(cand) AS x FROM q WHERE len(cand) > 0) q LEFT JOIN g ON g.src = q.x)
{result}"""


#: Labels that are still to sink, each vertex once; it ends when none does.
_COMPONENTS = """c(vid, component) USING KEY (vid) AS (SELECT vid, vid FROM v UNION SELECT s.dst, min(c.component) FROM c JOIN s ON s.src = c.vid JOIN recurring.c o ON o.vid = s.dst WHERE c.component < o.component GROUP BY s.dst)"""


def _formats_sql(by: str = "") -> str:
    """What _told() sums for all four kinds."""
    group = f", {by} AS part_id" if by else ""
    x = f"""x AS (SELECT v.vid{group}, sum(ascii(o.label)) + any_value(ascii(v.label)) AS labels, any_value(len(array_to_string(v.attrs, ''))) AS attrs, sum(s.weight) AS weights,
  count(s.dst) AS n, sum(s.dst) AS ids FROM v LEFT JOIN s ON s.src = v.vid LEFT JOIN v o ON o.vid = s.dst GROUP BY v.vid)"""
    part = ", part_id" if by else ""
    rows = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind{part}, count(*) AS vertices, CAST(sum(vid) AS BIGINT) AS vid_sum, CAST(sum(n) AS BIGINT) AS neighbours, CAST(sum(ids) AS BIGINT) AS id_sum, CAST(sum({extra}) AS BIGINT) AS extra_sum FROM x GROUP BY ALL"
        for kind, extra in (("normal", "0"), ("label", "labels"), ("attr", "attrs"), ("multi_attr", "attrs + weights"))
    )
    return f"WITH {_E}, {x} {rows}"


ORACLE_SQL: dict[str, str] = {
    "degree_stats": f"WITH {_E}, d AS (SELECT vid, count(src) AS degree FROM v LEFT JOIN s ON s.src = v.vid GROUP BY vid) SELECT count(*) AS vertices, min(degree) AS least, max(degree) AS most, CAST(sum(degree) AS BIGINT) AS total FROM d",
    "edge_weights": f"WITH {_E} SELECT weight, count(*) AS edges FROM e GROUP BY weight",
    "tc_per_vertex": f"WITH {_E}, {_T}, {_PV} SELECT vid, triangles FROM pv",
    "tc_per_seed": f"WITH {_E}, {_T} SELECT a AS vid, count(*) AS triangles FROM t GROUP BY a",
    "clustering": f"WITH {_E}, {_T}, {_PV}, d AS (SELECT src AS vid, count(*) AS degree FROM s GROUP BY src HAVING count(*) >= 2) SELECT vid, degree, coalesce(triangles, 0) AS triangles, 2.0::DOUBLE * coalesce(triangles, 0) / (degree * (degree - 1)) AS coefficient FROM d LEFT JOIN pv USING (vid)",
    "k4_count": f"WITH {_E}, {_T}, g AS (SELECT src, list(dst) AS gt FROM e GROUP BY src) SELECT CAST(coalesce(sum(len(list_intersect(list_intersect(x.gt, y.gt), z.gt))), 0) AS BIGINT) AS four_cliques FROM t JOIN g x ON x.src = a JOIN g y ON y.src = b JOIN g z ON z.src = c",
    "mc_levels": _cliques_sql("SELECT CAST(k AS INTEGER) AS size, count(*) AS cliques FROM q WHERE k > 1 GROUP BY k UNION ALL SELECT 1, count(*) FROM v"),
    "gm_count": f"WITH {_E}, {_GM} SELECT CAST(coalesce(sum(matches), 0) AS BIGINT) AS matches FROM m",
    "gm_matches_by_a": f"WITH {_E}, {_GM} SELECT a, CAST(matches AS BIGINT) AS matches FROM m WHERE matches > 0",
    "gm_match": f"WITH {_E}, l AS (SELECT s.src, s.dst, x.label AS ls, y.label AS ld FROM s JOIN v x ON x.vid = s.src JOIN v y ON y.vid = s.dst), m AS (SELECT ab.src AS a, ac.dst AS c, ab.dst AS b1 FROM l ab JOIN l ac ON ab.src = ac.src AND ac.ls = 'a' AND ac.ld = 'c' JOIN l cb ON cb.src = ac.dst AND cb.dst = ab.dst WHERE ab.ls = 'a' AND ab.ld = 'b'), n AS (SELECT a, x.dst AS b2, count(*) AS n FROM m JOIN l x ON x.src = m.c AND x.ld = 'b' AND x.dst <> m.b1 GROUP BY ALL) SELECT a, y.dst AS d, CAST(sum(n) AS BIGINT) AS matches FROM n JOIN l y ON y.src = n.b2 AND y.ld = 'd' GROUP BY ALL",
    "label_nb_counts": f"WITH {_E} SELECT src AS vid, label, count(*) AS neighbours FROM s JOIN v ON v.vid = s.dst GROUP BY src, label",
    "cd_seeds": f"WITH {_E}, d AS (SELECT src FROM s GROUP BY src HAVING count(*) > 1) SELECT e.src AS vid, CAST(count(*) AS INTEGER) AS candidates, CAST(any_value(len(attrs)) AS INTEGER) AS attrs FROM e JOIN d USING (src) JOIN v ON v.vid = e.src GROUP BY e.src HAVING count(*) >= 2",
    "cd_exact_triangles": f"WITH {_E}, f AS (SELECT src, dst, list_intersect(x.attrs, y.attrs) AS both FROM e JOIN v x ON x.vid = src JOIN v y ON y.vid = dst WHERE list_has_any(x.attrs, y.attrs)), t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, list_intersect(x.both, y.both) AS common FROM f x JOIN f y ON x.dst = y.src JOIN f z ON z.src = x.src AND z.dst = y.dst) SELECT a, b, c, CAST(len(common) AS INTEGER) AS n_common FROM t WHERE len(common) > 0",
    "fco_seed_cores": f"WITH {_E}, {_CORE} SELECT vid, CAST(core_size AS INTEGER) AS core_size FROM sz",
    "phi_scores": f"WITH {_E}, {_CORE}, x AS (SELECT c.vid, c.core_size, sum(CASE WHEN i.m IS NULL THEN s.weight ELSE 0 END) AS cut, sum(CASE WHEN i.m IS NOT NULL AND c.m < s.dst THEN s.weight ELSE 0 END) AS inside FROM core c JOIN s ON s.src = c.m LEFT JOIN core i ON i.vid = c.vid AND i.m = s.dst GROUP BY c.vid, c.core_size) SELECT vid, CAST(core_size AS INTEGER) AS core_size, CAST(cut AS DOUBLE) AS cut, CAST(inside AS DOUBLE) AS \"inner\", CASE WHEN inside <> 0 THEN CAST(cut AS DOUBLE) / CAST(inside AS DOUBLE) ELSE -1.0::DOUBLE END AS phi FROM x",
    "fco_topk_candidates": f"WITH {_E}, {_CORE}, f AS (SELECT c.vid, c.core_size, s.dst AS candidate, min(spot) AS spot, CAST(arg_min(s.weight, spot) AS DOUBLE) AS weight FROM core c JOIN s ON s.src = c.m WHERE NOT EXISTS (SELECT 1 FROM core i WHERE i.vid = c.vid AND i.m = s.dst) GROUP BY c.vid, c.core_size, s.dst), r AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY weight DESC, spot, candidate) AS place FROM f) SELECT vid, candidate, weight, CAST(place AS INTEGER) AS place FROM r WHERE place <= floor({FOCUS.candidates} * core_size)",
    "hash_partition_sizes": f"SELECT CAST(abs(p_partkey) % {PARTS} AS INTEGER) AS part_id, count(*) AS vertices FROM part GROUP BY 1",
    "hash_cut_stats": f"WITH {_E}, x AS (SELECT * FROM e WHERE src % {PARTS} <> dst % {PARTS}) SELECT (SELECT count(*) FROM x) AS cross_edges, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT u) FROM (SELECT src AS u FROM x UNION ALL SELECT dst FROM x)) AS boundary_vertices, (SELECT count(*) FROM v) AS vertices",
    "cc_hashmin": f"WITH RECURSIVE {_E}, {_COMPONENTS} SELECT vid, component FROM c",
    "formats_raw": _formats_sql(),
    "formats_partitioned": _formats_sql(f"CAST(any_value(abs(v.vid) % {PARTS}) AS INTEGER)"),
    "neighbour_parts": f"WITH {_E} SELECT CAST(src % {PARTS} AS INTEGER) AS part_id, CAST(dst % {PARTS} AS INTEGER) AS near_part, count(*) AS entries FROM s GROUP BY ALL",
    "cc_nations": "SELECT -1 - CAST(c_nationkey AS BIGINT) AS component, count(*) + 1 AS vertices FROM customer GROUP BY c_nationkey",
    "pregel_hops": f"WITH RECURSIVE {_E}, h(vid, n) AS (SELECT min(vid), 0 FROM v UNION SELECT s.dst, h.n + 1 FROM h JOIN s ON s.src = h.vid WHERE h.n < 6), d AS (SELECT vid, min(n) AS n FROM h GROUP BY vid) SELECT CAST(coalesce(n, -1) AS INTEGER) AS hops, count(*) AS vertices FROM v LEFT JOIN d USING (vid) GROUP BY 1",
    "block_info": f"WITH {_E}, n AS (SELECT src % 37 AS color, dst % 37 AS other FROM s UNION SELECT vid % 37, vid % 37 FROM v) SELECT v.vid % 37 AS color, count(DISTINCT v.vid) AS size, count(DISTINCT other) AS n_neighbours FROM v JOIN n ON n.color = v.vid % 37 GROUP BY 1",
    "block_histogram": "SELECT CAST(length(CAST(size AS VARCHAR)) AS INTEGER) AS digits, count(*) AS blocks FROM (SELECT p_partkey % 37, count(*) AS size FROM part GROUP BY 1) GROUP BY 1",
    "minhash_signatures": _minhash_sql(),
}
for _name in ("mc_size", "mc_bnb", "mc_tasks"):
    ORACLE_SQL[_name] = _cliques_sql("SELECT CAST(max(k) AS INTEGER) AS max_clique FROM q")
ORACLE_SQL["gm_tasks"] = ORACLE_SQL["gm_matches_by_a"]
for _name in ("tc_array", "tc_join", "tc_tasks"):
    ORACLE_SQL[_name] = f"WITH {_E}, {_T} SELECT count(*) AS triangles FROM t"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
