"""Numeric rules as Column expressions: safe means, saturating cost, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def safe_mean(value: Column) -> Column:
    return F.coalesce(F.avg(value.cast("double")), F.lit(0.0))


def population_variance(value: Column) -> Column:
    return F.coalesce(F.var_pop(value.cast("double")), F.lit(0.0))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def saturating_cost(cost: Column) -> Column:
    return cost / (cost + F.lit(100.0))


def success_per_1k_tokens(success_rate: Column, total_tokens: Column, agent_tokens: Column) -> Column:
    total, agent = zero_if_null(total_tokens), zero_if_null(agent_tokens)
    cost = F.when(total > 0, total).otherwise(agent)
    return F.when(cost > 0, F.lit(1000.0) * zero_if_null(success_rate) / cost).otherwise(0.0)


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def unit(vector: Column) -> Column:
    """Row L2 normalisation with the norm floored."""
    length = F.greatest(norm(vector), F.lit(FLOOR))
    return F.transform(vector, lambda x: x.cast("double") / length)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / F.greatest(norm(left) * norm(right), F.lit(FLOOR))


def correlation(left: Column, right: Column) -> Column:
    """Pearson from population moments; 0 for a constant or empty column."""
    spread = F.sqrt(F.var_pop(left)) * F.sqrt(F.var_pop(right))
    return F.coalesce(F.try_divide(F.covar_pop(left, right), spread), F.lit(0.0))
