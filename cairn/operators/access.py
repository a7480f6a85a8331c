"""Who may see what: actors, visible collections, parameters and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults and limits of a search.
TOP_K, MIN_SCORE, RERANK, MAX_TOP_K = 10, 0.10, False, 100


def may_read(admin: Column, published: Column, scopes: Column, required: Column, tenant: Column, tenants: Column) -> Column:
    """An administrator; or a published collection, a scope in common, and no tenant list or the actor's tenant on it."""
    in_tenants = (F.size(tenants) == 0) | F.coalesce(F.array_contains(tenants, tenant), F.lit(False))
    return admin | (F.coalesce(published, F.lit(False)) & F.coalesce(F.arrays_overlap(scopes, required), F.lit(False)) & in_tenants)


def actors(claims: DataFrame) -> DataFrame:
    """(actor, scopes, tenant) of claims(actor, kind, value): more than one tenant claim gives none."""
    tenant = F.when(F.count_distinct(F.when(F.col("kind") == "tenant", F.col("value"))) == 1, F.max(F.when(F.col("kind") == "tenant", F.col("value"))))
    return claims.groupBy("actor").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "scope", F.col("value")))).alias("scopes"), tenant.alias("tenant"))


def effective(request: Column, profile: Column, default) -> Column:
    return F.coalesce(request, profile, F.lit(default))


def parameter_error(top_k: Column, min_score: Column) -> Column:
    """What is wrong with a search's parameters; null if nothing."""
    return F.when(~top_k.between(1, MAX_TOP_K), "topK").when(F.isnan(min_score) | ~min_score.between(0, 1), "minScore")


def finite(score: Column) -> Column:
    """The score, or an error."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a score is not finite"))).otherwise(score)
