"""Notes and their typed relations as a property graph of two DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import norm_relation, stable_key
from folioframe.operators.components import connected_components
from folioframe.session import materialize


def build_graph(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of notes (``doc``, ``id``, ``char_pos``, ``anchor``, ``note``, ``tags``, ``relations``).

    Every note is a node; notes without an id get one from their content; of
    equal ids the last by position wins. Edges keep unknown targets.
    """
    key = F.coalesce(F.col("id").cast("string"), stable_key(F.col("doc").cast("string"), "anchor", "note", F.col("char_pos").cast("string"), n=8))
    named = notes.withColumn("id", key)
    last = Window.partitionBy("id").orderBy(F.desc("doc"), F.desc("char_pos"))
    nodes = named.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "relations")
    edges = named.select(F.col("id").alias("src"), F.explode("relations").alias("r")).select(
        "src", F.col("r.target_id").cast("string").alias("dst"), F.coalesce(norm_relation(F.col("r.rel_type")), F.lit("SEE_ALSO")).alias("rel_type"), F.col("r.note").alias("note")
    )
    return nodes, edges


def neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-edges with the other node's columns, null for unknown targets."""
    other = nodes.select(F.col("id").alias("dst"), F.struct(*nodes.columns).alias("other"))
    return edges.join(other, "dst", "left")


def reverse_neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In-edges with the source node's columns."""
    other = nodes.select(F.col("id").alias("src"), F.struct(*nodes.columns).alias("other"))
    return edges.join(other, "src", "left")


def all_relations(notes: DataFrame) -> DataFrame:
    """One row per relation of each note; notes without any have nulls."""
    return notes.select("doc", "id", F.explode_outer("relations").alias("relation"))


def related_notes(notes: DataFrame) -> DataFrame:
    """Relations with their target note, looked up by (document, id); unknown targets are kept."""
    rel = all_relations(notes).filter("relation is not null").select("doc", "id", "relation.*")
    target = notes.select(F.col("doc").alias("target_doc"), F.col("id").alias("target_id"), F.struct("anchor", "note").alias("target"))
    return rel.join(target, ["target_doc", "target_id"], "left")


def touched(edges: DataFrame, rel_types: list[str]) -> DataFrame:
    """Ids at either end of an edge of the listed types."""
    of = edges.filter(F.col("rel_type").isin(*rel_types))
    return of.select(F.col("src").alias("id")).union(of.select("dst")).distinct()


def search_graph(nodes: DataFrame, edges: DataFrame, *, query: str = "", rel_types: list[str] | None = None, docs: list | None = None, tags: list[str] | None = None) -> DataFrame:
    """Nodes that meet all given criteria."""
    out = nodes
    if query:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "anchor", "note")), F.lit(query.lower())))
    if docs is not None:
        out = out.filter(F.col("doc").isin(*docs))
    if tags:
        out = out.filter(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    if rel_types:
        out = out.join(touched(edges, rel_types), "id", "left_semi")
    return out


def subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def connected_component(nodes: DataFrame, edges: DataFrame, seed: object) -> DataFrame:
    """Ids reachable from a seed without passing through ids that are no nodes.

    Grows a frontier; each step is one join of the frontier with the edges,
    written to the shared folder.
    """
    inside = materialize(subgraph(nodes, edges).select("src", "dst"), "graph-edges")
    both = inside.union(inside.select("dst", "src")).toDF("src", "dst")
    seen = materialize(nodes.select("id").filter(F.col("id") == F.lit(seed)).distinct(), "graph-seen")
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("id", "src").join(both, "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen, "id", "left_anti"), "graph-frontier")
        seen = seen.unionByName(frontier)
    return seen


def all_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``id``, ``component``) of every node; orphans are their own."""
    found = connected_components(subgraph(nodes, edges)).withColumnRenamed("node", "id")
    return nodes.select("id").distinct().join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def degree_stats(nodes: DataFrame, edges: DataFrame, orphans: bool = True) -> DataFrame:
    """(``id``, ``out_degree``, ``in_degree``) of the nodes."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    found = nodes.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["out_degree", "in_degree"])
    return found if orphans else found.filter("out_degree + in_degree > 0")


def apply_edge_changes(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected changes) after a log of ``add`` and ``remove`` rows.

    ``edges`` has ``position`` in its source's list. An addition needs its
    source node; a removal names a position, one out of range does nothing.
    """
    adds, removals = changes.filter("action = 'add'"), changes.filter("action = 'remove'")
    ids = nodes.select(F.col("id").alias("src"))
    kept = edges.join(removals.select("src", "position"), ["src", "position"], "left_anti")
    most = edges.groupBy("src").agg((F.max("position") + 1).alias("_next"))
    new = adds.join(ids, "src", "left_semi").join(most, "src", "left")
    place = F.coalesce("_next", F.lit(0)) + F.row_number().over(Window.partitionBy("src").orderBy("seq")) - 1
    new = new.withColumn("position", place).select(*edges.columns)
    rejected = adds.join(ids, "src", "left_anti").unionByName(removals.join(edges.select("src", "position"), ["src", "position"], "left_anti"))
    return kept.unionByName(new), rejected
