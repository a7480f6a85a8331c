"""Corpus census, symbol census and graph walks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.sharing import count_pairs


def corpus_census(files: DataFrame) -> DataFrame:
    """(root, extension, state, files, unique_files, duplicates, unique_bytes) by root and over all ('*'), of files(root, extension, state, hash, size, walk).

    A file is unique if no earlier one of its root has its hash; sums over roots count a file once for each root.
    """
    first = files.withColumn("u__", (F.row_number().over(Window.partitionBy("root", "hash").orderBy("walk")) == 1) | F.col("hash").isNull())
    sums = first.groupingSets([[F.col("root"), F.col("extension"), F.col("state")], [F.col("extension"), F.col("state")]], F.col("root"), F.col("extension"), F.col("state")).agg(
        F.count("*").alias("files"), F.count_if("u__").alias("unique_files"), F.count_if(~F.col("u__")).alias("duplicates"), F.sum(F.when(F.col("u__"), F.col("size")).otherwise(0)).alias("unique_bytes"), F.grouping("root").alias("g")
    )
    return sums.select(F.when(F.col("g") == 1, "*").otherwise(F.col("root")).alias("root"), "extension", "state", "files", "unique_files", "duplicates", "unique_bytes")


def admission(extension, structural: list[str], fallback: list[str]):
    return F.when(extension.isin(structural), "admitido_estructural").when(extension.isin(fallback), "admitido_fallback").otherwise("no_admitido")


def reduction(chunks: DataFrame, groups: list[str]) -> DataFrame:
    """(chunks, groups, factor)."""
    return chunks.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.sum("n").alias("chunks"), F.count("*").alias("groups")).withColumn("factor", F.round(F.col("chunks") / F.col("groups"), 2))


def symbol_join(symbols: DataFrame) -> DataFrame:
    """(tenant, pairs) of symbols(id, tenant, symbol, kind): distinct ordered pairs of a user and a definer in one tenant."""
    sets = symbols.groupBy("id", "tenant").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("symbol"))).alias(k) for k in ("defined", "consumed")))
    return symbol_sets_join(sets)


def symbol_sets_join(sets: DataFrame) -> DataFrame:
    """The same of sets(id, tenant, defined, consumed), arrays of symbols.

    A pair counts once however many symbols join it. Pairs are bits of blocks of ids, which are counted and never stored: what
    is stored are the sets. Work still grows with the square of a tenant, a 64th of an operation a pair and symbol.
    """
    side = lambda kind: sets.select("tenant", F.col("id").cast("long").alias("id"), F.col(kind).alias("keys"))
    return count_pairs(side("defined"), side("consumed"), "tenant")


def walk(edges: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, allowed: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): nodes within `hops` of a seed, over allowed nodes only at every hop, at their least distance.

    edges(src, dst), seeds(node), allowed(node). Edges may be a function that gives those of nodes(node), which is asked at each hop for
    the nodes of the frontier alone. One join for each hop; the frontier carries what is not yet visited.
    """
    seen = seeds.join(allowed, "node", "left_semi").select(F.col("node").alias("seed"), "node", F.lit(0).cast("long").alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        if callable(edges):
            front = front.persist()
        links = (edges(front.select("node").distinct()) if callable(edges) else edges).where("src <> dst").select("src", "dst").distinct()
        reached = front.join(links, front["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct().join(allowed, "node", "left_semi")
        front = reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).cast("long").alias("hop"))
        seen = seen.unionByName(front)
    return seen


def replace_document(nodes: DataFrame, edges: DataFrame, applied: DataFrame, event: str, document: str, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a document's nodes replaced and every edge that touched them dropped; an event that has been applied changes nothing.

    nodes(node, document), edges(src, dst), applied(event).
    """
    done = applied.where(F.col("event") == event).select(F.lit(1).alias("done__")).limit(1)
    old = nodes.where(F.col("document") == document).select("node")
    fresh_nodes = nodes.where(F.col("document") != document).unionByName(new_nodes)
    kept = edges.join(old.withColumnRenamed("node", "src"), "src", "left_anti").join(old.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    fresh_edges = kept.unionByName(new_edges).distinct()

    def choose(fresh: DataFrame, was: DataFrame) -> DataFrame:
        flag = F.broadcast(done)  # at most one row
        return fresh.join(flag, F.lit(True), "left_anti").unionByName(was.select(*fresh.columns).join(flag, F.lit(True), "left_semi"))

    return choose(fresh_nodes, nodes), choose(fresh_edges, edges)


def member_runs(members: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """(by, kind, run, first, last, n): islands of neighbouring members of one kind."""
    place = members.withColumn("i__", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    island = place.withColumn("run__", F.col("i__") - F.row_number().over(Window.partitionBy(by, kind).orderBy("i__")))
    return island.groupBy(by, kind, "run__").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run__")
