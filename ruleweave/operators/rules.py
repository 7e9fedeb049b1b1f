"""Rule sets over event frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.model import AggregateKey, DefinitionError, Rule, aggregate_keys, check_compiles, unique_keys, validate_node
from ruleweave.operators.aggregates import columns_for, with_aggregates
from ruleweave.operators.events import LATENESS, arrives_in_order, scope_fields, with_time, with_watermark
from ruleweave.plans.compiler import Scope, compile_node, fires


@dataclass
class RuleSet:
    """Active rules that compile, their aggregates (each once), and what was wrong with the others."""

    rules: list[Rule]
    keys: list[AggregateKey]
    errors: dict[int, str]


def compile_ruleset(rules: list[Rule]) -> RuleSet:
    good, errors = [], {}
    for rule in rules:
        if rule.status != 1:
            continue
        try:
            validate_node(rule.node)
            check_compiles(rule.node)
            good.append(rule)
        except DefinitionError as e:
            errors[rule.id] = str(e)
    return RuleSet(good, unique_keys(k for r in good for k in aggregate_keys(r.node)), errors)


def evaluate(events: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Of events with aggregates: one row for each event and rule that fires."""
    columns = columns_for(ruleset.keys)
    scope = Scope(scope_fields(events), {k: F.col(c) for k, c in columns.items()})
    fired = [F.when(fires(compile_node(r.node, scope)), F.struct(F.lit(r.id).cast("bigint").alias("rule_id"), F.lit(r.name).alias("rule_name"))) for r in ruleset.rules]
    if not fired:
        return events.select("seq", "event_id", "member_id", F.lit(None).cast("bigint").alias("rule_id"), F.lit(None).cast("string").alias("rule_name")).filter("false")
    return events.select("seq", "event_id", "member_id", F.explode(F.array_compact(F.array(*fired))).alias("r_")).select("seq", "event_id", "member_id", "r_.*")


def rule_matches(events: DataFrame, rules: list[Rule] | RuleSet, order: str = "auto", lateness: float = LATENESS, shards: int = 1, semantics: str = "as_coded") -> DataFrame:
    """seq, event_id, member_id, rule_id, rule_name of an event frame. Late events feed aggregates but aren't evaluated.

    In order no event can be late, so the shards' watermarks, and their shuffle, are left out. order: "in_order" where that is known, "disordered", or "auto", which looks first.
    """
    ruleset = rules if isinstance(rules, RuleSet) else compile_ruleset(rules)
    timed = with_time(events)
    if order == "auto":
        order = "in_order" if arrives_in_order(timed) else "disordered"
    if order != "in_order":
        timed = with_watermark(timed, lateness, shards)
    found = with_aggregates(timed, ruleset.keys, order, semantics)
    return evaluate(found.filter("not late_") if order != "in_order" else found, ruleset)


def late_events(events: DataFrame, lateness: float = LATENESS, shards: int = 1) -> DataFrame:
    """The side output: late events as they came."""
    return with_watermark(with_time(events), lateness, shards).filter("late_").select(*events.columns)
