"""Registries of sources, topics, scholars and interests from TOML, and their checks."""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KINDS, TIERS, schema
from . import adapters

SELECTORS = ["list", "list_link", "detail_title", "detail_date", "detail_location", "detail_description", "detail_speaker", "list_title", "list_date"]
REQUIRED_SELECTORS = SELECTORS[:4]
SOURCE = (
    "ord int, id string, name string, tier string, kind string, adapter string, entrypoint string, allowed_hosts array<string>, max_depth int, "
    "request_budget int, media_strategy string, dynamic boolean, enabled boolean, fixture string, selectors struct<" + ",".join(f"{k}:string" for k in SELECTORS) + ">"
)
_DEFAULTS: dict[str, Any] = {"tier": "unknown", "kind": "other", "adapter": "none", "entrypoint": None, "allowed_hosts": [], "max_depth": 2, "request_budget": 20, "media_strategy": None, "dynamic": False, "enabled": True, "fixture": None, "selectors": None}


class RegistryError(ValueError):
    """A registry that can't be used."""


def sources(spark: SparkSession, toml: str) -> DataFrame:
    """The sources of a registry text; unknown fields and values fail."""
    try:
        found = tomllib.loads(toml).get("sources", [])
    except tomllib.TOMLDecodeError as e:
        raise RegistryError(str(e)) from e
    rows = []
    for k, s in enumerate(found):
        odd = set(s) - {"id", "name", *_DEFAULTS} | set(s.get("selectors") or {}) - set(SELECTORS)
        if odd:
            raise RegistryError(f"unknown fields: {', '.join(sorted(odd))}")
        if "id" not in s or "name" not in s:
            raise RegistryError("a source needs id and name")
        own = _DEFAULTS | s | {"ord": k}
        for name, known in (("tier", TIERS), ("kind", KINDS), ("adapter", adapters.ADAPTERS)):
            if own[name] not in known:
                raise RegistryError(f"{own['id']}: no such {name}: {own[name]}")
        if own["selectors"] is not None:
            own["selectors"] = {n: own["selectors"].get(n) for n in SELECTORS}
        rows.append(own)
    return spark.createDataFrame(rows, schema(SOURCE))


def violations(specs: DataFrame) -> DataFrame:
    """(ord, rule, id) of every broken rule; rules are numbered in the order in which they are told."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    repeated = specs.groupBy("id").agg(F.min("ord").alias("first_ord"))
    rows = specs.join(repeated, "id", "left")
    on, configured = F.col("enabled"), F.col("adapter") == "html_config"
    rules = [
        ("duplicate id", F.col("ord") > F.col("first_ord")),
        ("empty id", blank(F.col("id"))),
        ("empty name", blank(F.col("name"))),
        ("missing entrypoint", on & F.col("entrypoint").isNull()),
        ("entrypoint scheme", on & F.col("entrypoint").isNotNull() & ~F.coalesce(F.col("entrypoint").rlike("^(?i:https?)://"), F.lit(False))),
        ("empty allowed host", F.exists("allowed_hosts", lambda h: F.trim(h) == "")),
        ("max_depth", F.col("max_depth") < 1),
        ("request_budget", F.col("request_budget") < 1),
        ("missing selectors", configured & F.col("selectors").isNull()),
        *[(f"empty selector {k}", configured & F.col("selectors").isNotNull() & blank(F.col(f"selectors.{k}"))) for k in REQUIRED_SELECTORS],
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(k).alias("rule_ord"), F.lit(name).alias("rule"))) for k, (name, bad) in enumerate(rules)]))
    return rows.select("ord", "id", F.explode(found).alias("v")).select("ord", "id", "v.rule_ord", "v.rule")


def validated(specs: DataFrame) -> DataFrame:
    """The sources, if all rules hold; or the first violation as an error."""
    first = violations(specs).orderBy("ord", "rule_ord").limit(1).collect()
    if first:
        raise RegistryError(f"{first[0]['id']}: {first[0]['rule']}")
    return specs


def enabled(specs: DataFrame) -> DataFrame:
    return specs.filter("enabled")


def named(toml: str, table: str, fields: tuple[str, ...]) -> list[dict[str, Any]]:
    """Records of a registry of names (topics or scholars)."""
    rows = tomllib.loads(toml).get(table, [])
    for r in rows:
        if any(f not in r for f in fields):
            raise RegistryError(f"{table} need {', '.join(fields)}")
    return rows


def topics(toml: str) -> list[dict[str, Any]]:
    return named(toml, "topics", ("id", "name"))


def scholars(toml: str) -> list[dict[str, Any]]:
    return named(toml, "scholars", ("id", "canonical_name"))


def interests(toml: str) -> dict[str, float]:
    return {k: float(v) for k, v in tomllib.loads(toml).get("interests", {}).items()}


def listing(specs: DataFrame) -> DataFrame:
    """One line of fixed width for each source."""
    return specs.orderBy("ord").select(F.format_string("%-24s %-40s %-8s %-14s %s", "id", "name", "tier", "adapter", F.when(F.col("enabled"), "enabled").otherwise("disabled")).alias("line"))
