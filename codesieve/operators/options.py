"""Layered options of a scan (P7-P11, P13): request, user, global and environment values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.functions import text


def resolve_sector(request: Column, configured: Column) -> Column:
    return F.coalesce(text.blank_to_null(request), configured, F.lit(fv.DEFAULT_SECTOR))


def residency_violations(batches: DataFrame, enforced: str | None) -> DataFrame:
    """Batches whose configured residency differs from the enforced one; both must be set."""
    if not enforced:
        return batches.where(F.lit(False))
    return batches.where((F.col("data_residency") != "") & (F.col("data_residency") != enforced))


def resolve_require_review(request: Column, user: Column, global_: Column, environment: Column, default: bool = True) -> Column:
    env = F.when(environment.isNotNull(), F.lower(environment) == "true")
    return F.coalesce(request, user, global_, env, F.lit(default))


def resolve_model(request: Column, user: Column, global_: Column, environment: Column) -> Column:
    return F.coalesce(text.blank_to_null(text.strip(request)), text.blank_to_null(user), global_, environment)


def resolve_max_chars(request: Column, user: Column, global_: Column, environment: Column) -> Column:
    """Only positive numbers count; the environment value must consist of digits."""
    positive = [F.when(c > 0, c) for c in (request, user, global_)]
    env = F.when(environment.rlike("^[0-9]+$"), environment.cast("int"))
    return F.coalesce(*positive, env)


def resolve_fix_mode(no_fix: Column, safe_fix: Column, full_fix: Column, stored_mode: Column, stored_autofix: Column) -> Column:
    """full, safe or none: flags first, then the stored mode, then the stored switch, else off."""
    return (
        F.when(no_fix, "none")
        .when(safe_fix, F.when(full_fix, "full").otherwise("safe"))
        .when(stored_mode == "full", "full")
        .when(stored_mode == "none", "none")
        .when(full_fix, "full")
        .when(stored_mode == "safe", "safe")
        .when(stored_autofix, "safe")
        .otherwise("none")
    )


def resolve_toggles(flat: Column, per_language: Column, language: Column) -> Column:
    """Struct of the built-in coding checks that are on.

    ``flat`` is a struct of booleans that wins when it sets naming, logging or error_handling;
    ``per_language`` is a map of such structs with an optional ``default``.
    """
    names = ["naming", "logging", "error_handling", "typing"]
    flat_set = reduce(or_, [flat[n].isNotNull() for n in names[:3]])
    chosen = (
        F.when(flat_set, flat)
        .when(F.map_contains_key(per_language, language), F.element_at(per_language, language))
        .otherwise(F.try_element_at(per_language, F.lit("default")))
    )
    return F.struct(*[F.coalesce(chosen[n], F.lit(True)).alias(n) for n in names])


def ai_generated(config_flag: Column, env_value: Column, labels: Column, config_labels: Column, title: Column, body: Column,
                 commit_messages: Column) -> Column:
    """Whether a change counts as generated; a configured boolean decides alone."""
    known = F.when(F.size(config_labels) > 0, F.transform(config_labels, F.lower)).otherwise(
        F.array(*[F.lit(x) for x in fv.AI_LABELS]))
    labelled = F.coalesce(F.arrays_overlap(F.transform(labels, F.lower), known), F.lit(False))
    told = F.coalesce(F.exists(commit_messages, text.mentions_copilot), F.lit(False))
    return F.coalesce(
        config_flag,
        text.truthy(env_value) | labelled | text.mentions_copilot(title) | text.mentions_copilot(body) | told)


def ai_generated_push(env_value: Column, commit_messages: Column) -> Column:
    """The same for a push: only the environment and the commit messages are looked at."""
    none = F.lit(None)
    return ai_generated(none.cast("boolean"), env_value, none.cast("array<string>"), none.cast("array<string>"),
                        none.cast("string"), none.cast("string"), commit_messages)
