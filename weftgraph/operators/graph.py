"""The graph model: vertices and canonical undirected edges, with the views that operators share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import materialise


@dataclass(frozen=True)
class Graph:
    """vertices(vid, label?, attrs?) and edges(src < dst, weight?), each edge once and no loops."""

    vertices: DataFrame
    edges: DataFrame

    def stored(self) -> "Graph":
        """The same graph with its edges written once to the shared folder, for operators that read them several times."""
        return Graph(self.vertices, materialise(self.edges, "edges"))

    def sym(self) -> DataFrame:
        """Both directions of every edge."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
        return self.edges.select("src", "dst", *rest).union(back)

    def degrees(self) -> DataFrame:
        """vid, degree of every vertex; isolated ones have 0."""
        counted = self.sym().groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"))
        return self.vertices.select("vid").join(counted, "vid", "left").fillna(0, ["degree"])

    def adjacency(self) -> DataFrame:
        """vid, adj: all neighbours, ascending."""
        return self.sym().groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list("dst")).alias("adj"))

    def greater(self) -> DataFrame:
        """vid, gt: neighbours with a larger id, ascending; only vertices that have one."""
        return self.edges.groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list("dst")).alias("gt"))

    def by_degree(self) -> "Graph":
        """The same graph with each edge from the smaller (degree, id) to the larger.

        Out-degrees are then at most about sqrt(2 E), whatever hubs there are. Only for operators that
        do not report which end is which.
        """
        degree = self.sym().groupBy(F.col("src").alias("_v")).agg(F.count("*").alias("_d"))
        a, b = degree.withColumnsRenamed({"_v": "_a", "_d": "_da"}), degree.withColumnsRenamed({"_v": "_b", "_d": "_db"})
        e = self.edges.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b"))
        swap = F.struct("_da", "src") > F.struct("_db", "dst")
        oriented = e.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"))
        return Graph(self.vertices, oriented).stored()


def normalise(pairs: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """Canonical edges of any list of pairs: src < dst, distinct, no loops, no nulls.

    With a weight, of a pair's several weights the largest stays.
    """
    a, b = F.least(src, dst), F.greatest(src, dst)
    rows = pairs.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    if weight is None:
        return rows.select(a.alias("src"), b.alias("dst")).distinct()
    return rows.select(a.alias("src"), b.alias("dst"), F.col(weight).alias("weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def from_adjacency(vertices: DataFrame) -> Graph:
    """The graph of parsed adjacency lists (vid, adj of ids or of structs with id and weight)."""
    last = vertices.dropDuplicates(["vid"])
    element = vertices.schema["adj"].dataType.elementType
    rows = last.select("vid", F.explode("adj").alias("n"))
    if hasattr(element, "names"):
        columns = [F.col("n.id").alias("dst"), *([F.col("n.weight").alias("weight")] if "weight" in element.names else [])]
        pairs = rows.select(F.col("vid").alias("src"), *columns)
    else:
        pairs = rows.select(F.col("vid").alias("src"), F.col("n").alias("dst"))
    weight = "weight" if "weight" in pairs.columns else None
    return Graph(last.drop("adj"), normalise(pairs, weight=weight))
