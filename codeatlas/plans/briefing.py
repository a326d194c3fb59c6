"""Project briefing (A12): one nested row per project, every part pre-aggregated
per project and joined on ``project``.

Unbounded lists stay out of the row: of the public API and the entry points it has
the numbers, the lists are the rows of ``nodes.public_api`` and
``nodes.entry_points``. ``generated_at`` is when the briefing was made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.operators import docs as docops
from codeatlas.operators import graph, nodes


def _ranked_array(df: DataFrame, fields, name: str) -> DataFrame:
    return df.groupBy("project").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", *fields))),
                    lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


def context(files: DataFrame, elements: DataFrame, edges: DataFrame, docs: DataFrame,
            projects: DataFrame | None = None, manifests: DataFrame | None = None,
            k: int = 10, recent: int = 5) -> DataFrame:
    summary = nodes.build_summary(files, elements)
    top = _ranked_array(nodes.top_files(files, elements, k), ["path", "elements"], "top_files")
    arch = summary.join(top, "project", "left").select(
        "project", F.struct("files", "elements", "top_files").alias("architecture"))
    es = graph.edge_summary(edges)
    hot = _ranked_array(graph.hotspots(edges, k), ["element", "inbound", "outbound"], "hotspots")
    dep = es.join(hot, "project", "left").select(
        "project", F.struct("total", "imports", "calls", "extends", "implements", "hotspots").alias("dependencies"))
    bt = docops.docs_by_type(docs)
    rec = _ranked_array(docops.recent_docs(docs, recent), ["element", "type", "updated_at"], "recent")
    doc = bt.join(rec, "project", "left").select(
        "project", F.struct("total", "by_type", "recent").alias("documentation"))
    ep_n = nodes.entry_points(files, manifests).groupBy("project").agg(F.count(F.lit(1)).alias("entry_points_count"))
    api_n = nodes.public_api(elements).groupBy("project").agg(F.count(F.lit(1)).alias("public_api_count"))
    keys = (files.select("project").union(edges.select("project")).union(docs.select("project"))
            .union(elements.select("project")).distinct())
    if projects is not None:
        keys = keys.union(projects.select("project")).distinct()
    out = (keys.join(arch, "project", "left").join(dep, "project", "left").join(doc, "project", "left")
           .join(ep_n, "project", "left").join(api_n, "project", "left"))
    if projects is not None:
        out = out.join(projects.select("project", F.struct("name", "language", "framework", "source_paths").alias("info")),
                       "project", "left")
    return out.withColumn("entry_points_count", F.coalesce("entry_points_count", F.lit(0))) \
        .withColumn("public_api_count", F.coalesce("public_api_count", F.lit(0))) \
        .withColumn("generated_at", F.current_timestamp())
