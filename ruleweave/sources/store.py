"""Rules and patterns in small tables, read on the driver; a rule that doesn't compile is refused when it is written."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from ruleweave.model import ACTIVE, INACTIVE, Pattern, Rule, check_compiles, node_from_json, pattern_from_json, validate_node
from ruleweave.operators.rules import RuleSet, compile_ruleset


class RuleStore:
    """Rules in one JSON file, written whole beside the old one and then moved over it."""

    def __init__(self, path: str):
        self.path = Path(path)
        self._compiled: RuleSet | None = None

    def _rows(self) -> list[dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else []

    def _save(self, rows: list[dict]) -> None:
        fresh = self.path.with_suffix(".new")
        fresh.write_text(json.dumps(rows))
        fresh.replace(self.path)
        self._compiled = None

    @staticmethod
    def _rule(row: dict) -> Rule:
        return Rule(row["id"], row["name"], node_from_json(row["rule_node"]), row["status"], row.get("description", ""))

    def list(self, status: int | None = None) -> list[Rule]:
        return [self._rule(r) for r in self._rows() if status in (None, r["status"])]

    def get(self, id_: int) -> Rule:
        for r in self.list():
            if r.id == id_:
                return r
        raise KeyError(id_)

    def create(self, name: str, rule_node: dict, description: str = "") -> Rule:
        self._check(rule_node)
        rows = self._rows()
        rows.append({"id": max((r["id"] for r in rows), default=0) + 1, "name": name, "description": description, "rule_node": rule_node, "status": ACTIVE})
        self._save(rows)
        return self._rule(rows[-1])

    def update(self, id_: int, name: str | None = None, rule_node: dict | None = None, description: str | None = None) -> Rule:
        if rule_node is not None:
            self._check(rule_node)
        given = {k: v for k, v in (("name", name), ("rule_node", rule_node), ("description", description)) if v is not None}
        return self._change(id_, given)

    def set_status(self, id_: int, status: int) -> Rule:
        if status not in (ACTIVE, INACTIVE):
            raise ValueError("status is 1 (active) or 2 (inactive)")
        return self._change(id_, {"status": status})

    def _change(self, id_: int, given: dict) -> Rule:
        rows = self._rows()
        row = next((r for r in rows if r["id"] == id_), None)
        if row is None:
            raise KeyError(id_)
        if given:
            row.update(given)
            self._save(rows)
        return self._rule(row)

    @staticmethod
    def _check(rule_node: dict) -> None:
        node = node_from_json(rule_node)
        validate_node(node)
        check_compiles(node)

    def compiled(self) -> RuleSet:
        """Active rules, compiled once until the next change; bad ones are set apart with their error."""
        if self._compiled is None:
            self._compiled = compile_ruleset(self.list(ACTIVE))
        return self._compiled


def rules_from_table(spark: SparkSession, path: str, status: int | None = ACTIVE) -> list[Rule]:
    """Rules of a stored table (id, name, description, rule_node, status)."""
    rows = spark.read.parquet(path)
    rows = rows if status is None else rows.filter(rows.status == status)
    return [Rule(r.id, r.name, node_from_json(r.rule_node), r.status, r.description or "") for r in rows.orderBy("id").collect()]


def patterns_from_table(spark: SparkSession, path: str) -> list[Pattern]:
    """Active patterns of a stored table (id, name, states, status)."""
    return [pattern_from_json(r.id, r.name, r.states, r.status) for r in spark.read.parquet(path).filter("status = 1").orderBy("id").collect()]
