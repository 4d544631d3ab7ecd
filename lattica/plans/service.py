"""The service's operations as plain functions: payload in, statistics and tables out.

A missing or empty required payload raises ValueError, as the service's answer 400 does.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vectors as V
from ..operators import bipartite, embed, itemgraph, recommend, users
from ..sources.sinks import records, write_parquet
from ..sources.tables import from_records

Payload = dict[str, Any]


def health() -> dict[str, str]:
    return {"status": "healthy", "message": "ready"}


def _tables(spark: SparkSession, payload: Payload | None, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, DataFrame | None]:
    """Payload entries as tables; an entry may be records or already a DataFrame."""
    if not payload:
        raise ValueError("the request has no data")
    missing = [n for n in required if payload.get(n) is None or (not isinstance(payload[n], DataFrame) and not payload[n])]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return {n: payload.get(n) if isinstance(payload.get(n), DataFrame) else from_records(spark, payload.get(n)) for n in (*required, *optional)}


def graph_tables(spark: SparkSession, payload: Payload) -> dict[str, DataFrame]:
    t = _tables(spark, payload, ("contents",), ("av", "game", "webnovel", "raw_item"))
    nodes = bipartite.build_nodes(t["contents"], t["av"], t["game"], t["webnovel"])
    genres = bipartite.raw_genres_wide(bipartite.raw_genres_tall(nodes, t["av"], t["game"], t["webnovel"]), t["raw_item"])
    meta, edges = bipartite.build_bipartite(nodes, genres)
    return {"nodes": nodes, "raw_genres": genres, "meta_nodes": meta, "edges": edges}


def _save(tables: dict[str, DataFrame], out: str | None) -> None:
    for name, df in tables.items() if out else ():
        write_parquet(df, f"{out}/{name}")


def _save_counted(tables: dict[str, DataFrame], out: str | None) -> dict[str, int]:
    """Rows of each table, counted by the job that writes it; without a folder, by one that writes nothing."""
    rows = {}
    for name, df in tables.items():
        seen = Observation(name)
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if out:
            write_parquet(counted, f"{out}/{name}")
        else:
            counted.write.format("noop").mode("overwrite").save()
        rows[name] = seen.get["rows"]
    return rows


def build_graph(spark: SparkSession, payload: Payload, out: str | None = None) -> dict[str, int]:
    t = graph_tables(spark, payload)
    n = _save_counted({"graph_nodes": t["nodes"], "content_raw_genres": t["raw_genres"], "meta_nodes": t["meta_nodes"], "graph_edges_bipartite": t["edges"]}, out)
    return {"content_nodes_count": n["graph_nodes"], "raw_genres_count": n["content_raw_genres"], "meta_nodes_count": n["meta_nodes"], "edges_count": n["graph_edges_bipartite"]}


def build_graph_get_result(spark: SparkSession, payload: Payload) -> dict[str, Any]:
    t = graph_tables(spark, payload)
    found = {name: records(df) for name, df in t.items()}
    return {"stats": {"content_nodes_count": len(found["nodes"]), "raw_genres_count": len(found["raw_genres"]), "meta_nodes_count": len(found["meta_nodes"]), "edges_count": len(found["edges"])}, **found}


def item_graph(spark: SparkSession, payload: Payload) -> DataFrame:
    t = _tables(spark, payload, ("nodes",), ("raw_genres",))
    return itemgraph.build_item_graph(t["nodes"], t["raw_genres"])


def build_item_graph(spark: SparkSession, payload: Payload, out: str | None = None) -> dict[str, int]:
    edges = item_graph(spark, payload)
    _save({"graph_edges_item_item": edges}, out)
    return {"edges_count": edges.count()}


def build_item_graph_get_result(spark: SparkSession, payload: Payload) -> dict[str, Any]:
    found = records(item_graph(spark, payload))
    return {"stats": {"edges_count": len(found)}, "edges": found}


def item_embeddings(spark: SparkSession, payload: Payload, **options: Any) -> DataFrame:
    return embed.item_embeddings(_tables(spark, payload, ("edges",))["edges"], **options)


def user_embeddings(spark: SparkSession, payload: Payload) -> DataFrame:
    t = _tables(spark, payload, ("item_embeddings", "raw_genres", "user_preferred_genres"), ("contents",))
    items = embed.typed_embeddings(t["item_embeddings"])
    dim = len(V.vector_columns(t["item_embeddings"])) or len(items.first()["vector"])
    return V.vector_to_wide(users.user_embeddings(items, t["raw_genres"], t["user_preferred_genres"], dim), dim)


def build_user_embeddings(spark: SparkSession, payload: Payload, out: str | None = None) -> dict[str, int]:
    found = user_embeddings(spark, payload)
    _save({"user_embeddings": found}, out)
    return {"user_count": found.count()}


def build_user_embeddings_get_result(spark: SparkSession, payload: Payload) -> dict[str, Any]:
    found = records(user_embeddings(spark, payload).orderBy("user_id"))
    return {"stats": {"user_count": len(found)}, "user_embeddings": found}


def run_chain(contents: DataFrame, av: DataFrame | None, game: DataFrame | None, webnovel: DataFrame | None, raw_item: DataFrame | None, prefs: DataFrame, dim: int = 64, top_k: int = 5, embedding_options: dict | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> dict[str, DataFrame]:
    """Catalogue tables to recommendations: every stage's table by name.

    `keep` holds what several stages read: by default in memory and on disk; on a large catalogue, pass a
    function that writes a table in shared storage and reads it back.
    """
    nodes = keep(bipartite.build_nodes(contents, av, game, webnovel))
    genres = keep(bipartite.raw_genres_wide(bipartite.raw_genres_tall(nodes, av, game, webnovel), raw_item))
    meta, edges = bipartite.build_bipartite(nodes, genres)
    graph = keep(itemgraph.build_item_graph(nodes, genres))
    items = keep(embed.item_embeddings(graph, dim, **(embedding_options or {})))
    people = keep(users.user_embeddings(items, genres, prefs, dim))
    return {
        "nodes": nodes,
        "raw_genres": genres,
        "meta_nodes": meta,
        "edges": edges,
        "item_graph": graph,
        "item_embeddings": items,
        "user_embeddings": people,
        "topk": recommend.with_meta(recommend.topk_cosine(people, items, top_k), nodes, people),
        "per_domain": recommend.domain_quota(people, items, nodes),
        "topk_genre": recommend.genre_recommendations(items, genres, prefs, nodes, dim, top_k),
        "topk_genre_recent": recommend.genre_recommendations(items, genres, prefs, nodes, dim, top_k, recommend.recent_ids(contents)),
    }
