"""Who may see what: rule matching by priority, scopes, instances.

Rules and instances are configuration tables of a few rows a tenant; they are the small side of a join that
compares every user with every rule of its kind, so the join is keyed by rule kind and value where it can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.predicates import scope_grants


def match_rules(users: DataFrame, rules: DataFrame, defaults: list[str]) -> DataFrame:
    """(user_id, rule_id, scopes): for each user the first matching rule by priority, else the default scopes.

    Users are (user_id, email, groups, roles), rules (rule_id, priority, pattern, scopes). A pattern is an
    e-mail address, ``*@domain``, ``group:name`` or ``role:name``, compared without regard to case. Each user
    is spread into the patterns that could match it, so the join is an equi-join.
    """
    email = F.lower("email")
    mine = F.concat(
        F.array(email, F.concat(F.lit("*@"), F.element_at(F.split(email, "@"), -1))),
        F.coalesce(F.transform("groups", lambda g: F.concat(F.lit("group:"), F.lower(g))), F.array().cast("array<string>")),
        F.coalesce(F.transform("roles", lambda r: F.concat(F.lit("role:"), F.lower(r))), F.array().cast("array<string>")),
    )
    keys = users.select("user_id", F.explode(F.array_distinct(mine)).alias("_p")).where(F.col("_p").isNotNull())
    best = (
        keys.join(rules.select(F.lower("pattern").alias("_p"), "rule_id", "priority", "scopes"), "_p")
        .groupBy("user_id")
        .agg(F.min(F.struct("priority", "rule_id", "scopes")).alias("_b"))
    )
    return users.select("user_id").distinct().join(best, "user_id", "left").select(
        "user_id", F.col("_b.rule_id").alias("rule_id"), F.coalesce(F.col("_b.scopes"), F.array(*[F.lit(x) for x in defaults])).alias("scopes")
    )


def reachable_instances(tokens: DataFrame, instances: DataFrame, default: str) -> DataFrame:
    """(token_id, instance): enabled instances that each token names; a token without any (or none at all) gets the default."""
    enabled = instances.where("enabled").select("instance")
    wanted = tokens.select("token_id", F.explode_outer("instances").alias("instance")).withColumn("instance", F.coalesce("instance", F.lit(default)))
    return wanted.distinct().join(enabled, "instance", "left_semi").select("token_id", "instance")


def permitted(requests: DataFrame) -> DataFrame:
    """Requests (granted, required scopes) that the granted scopes cover."""
    return requests.where(scope_grants(F.col("granted"), F.col("required")))
