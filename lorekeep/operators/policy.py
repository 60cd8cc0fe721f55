"""Policy rules over mutations: evaluation, severity, matches, approvals and halts."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal_path, path_pattern, text_pattern

#: From the most severe (fixed values).
ACTIONS = ("halt_agent", "require_approval", "warn", "allow")
MATCH_KINDS = ("file_path", "shell_command", "client", "session_cost", "error_rate")
PATH_CATEGORIES = ("file_read", "file_write", "tool_call")
COMMAND_CATEGORIES = ("shell_command", "tool_call")


@dataclass(frozen=True)
class Rule:
    """A rule; its kind says which of pattern, client_id and threshold it needs."""

    rule_id: int
    name: str
    match_kind: str
    action: str
    pattern: str | None = None
    client_id: int | None = None
    threshold: float | None = None
    window_events: int | None = None
    enabled: bool = True

    def __post_init__(self):
        needs = {"file_path": self.pattern, "shell_command": self.pattern, "client": self.client_id, "session_cost": self.threshold, "error_rate": self.threshold}
        if self.match_kind not in needs or self.action not in ACTIONS or needs[self.match_kind] is None:
            raise ValueError(f"rule {self.name!r} is not complete")


def rules_from_toml(text: str) -> list[Rule]:
    """S-11: an array of ``rule`` tables; unknown keys are refused."""
    found = tomllib.loads(text)
    if set(found) - {"rule"}:
        raise ValueError("only [[rule]] tables are known")
    known = {f.name for f in fields(Rule)}
    for r in found.get("rule", []):
        if extra := set(r) - known:
            raise ValueError(f"unknown keys {sorted(extra)}")
    return [Rule(**{"rule_id": i} | r) for i, r in enumerate(found.get("rule", []), 1)]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    kinds = "rule_id long, name string, match_kind string, action string, pattern string, client_id long, threshold double, window_events long, enabled boolean"
    return spark.createDataFrame([tuple(getattr(r, f.name) for f in fields(Rule)) for r in rules], kinds)


def rank(action: Column) -> Column:
    """F-27, O-10."""
    return F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action)


def error_share(window_events: int | None) -> Column:
    """A-14, W-04: the share of errors among a session's last events, this one included; all of them without a bound."""
    order = Window.partitionBy("session_id").orderBy("seq")
    span = order.rowsBetween(Window.unboundedPreceding if window_events is None else -(window_events - 1), 0)
    return F.avg((F.col("category") == "error").cast("double")).over(span)


def condition(rule: Rule) -> Column:
    """J-22: one rule's predicate over a mutation (category, path, command, client_id, session_cost, error_<n>)."""
    c = F.col
    if rule.match_kind == "file_path":
        return c("category").isin(*PATH_CATEGORIES) & (c("path") != "") & normal_path(c("path")).rlike(path_pattern(rule.pattern))
    if rule.match_kind == "shell_command":
        return c("category").isin(*COMMAND_CATEGORIES) & (c("command") != "") & c("command").rlike(text_pattern(rule.pattern))
    if rule.match_kind == "client":
        return c("client_id") == rule.client_id
    if rule.match_kind == "session_cost":
        return c("session_cost") > rule.threshold
    return c(f"error_{rule.window_events or 'all'}") > rule.threshold


def enrich(mutations: DataFrame, session: DataFrame, rules: list[Rule]) -> DataFrame:
    """ST-04: each mutation's session cost and the error shares that the rules ask for."""
    rows = mutations.join(session.select("session_id", F.col("cost_usd").alias("session_cost")), "session_id", "left")
    for n in sorted({r.window_events for r in rules if r.match_kind == "error_rate"}, key=lambda n: n or 0):
        rows = rows.withColumn(f"error_{n or 'all'}", error_share(n))
    return rows


def evaluate(mutations: DataFrame, rules: list[Rule]) -> DataFrame:
    """C-12: one row for each enabled rule that a mutation meets, with ``governing`` on the most severe (then name, id).

    Rules are few and known to the driver, so they unroll into one expression; no join, whatever the order rows come in.
    """
    ordered = sorted((r for r in rules if r.enabled), key=lambda r: (ACTIONS.index(r.action), r.name, r.rule_id))
    met = [F.when(condition(r), F.struct(F.lit(r.rule_id).cast("long").alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.action).alias("action"))) for r in ordered]
    empty = "array<struct<rule_id:bigint,rule_name:string,action:string>>"
    outcomes = F.filter(F.array(*met), lambda x: x.isNotNull()) if met else F.array().cast(empty)
    found = mutations.withColumn("_met", outcomes)
    return found.select("event_id", "session_id", "client_id", "category", F.posexplode("_met").alias("_place", "_o")).select("event_id", "session_id", "client_id", "category", "_o.*", (F.col("_place") == 0).alias("governing"))


def new_matches(found: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """D-14, ST-05: one row for each (rule, session, event) not stored yet; a null event is never a duplicate."""
    keys = ["rule_id", "session_id", "event_id"]
    named = found.where("event_id is not null").dropDuplicates(keys)
    if stored is not None:
        named = named.join(stored.select(*keys), keys, "left_anti")
    return named.unionByName(found.where("event_id is null"))


def halts(found: DataFrame, session: DataFrame) -> DataFrame:
    """D-14: sessions that a halt rule stops now: the first event that did it; a session halted before is not touched."""
    live = session.where("outcome = 'in_progress'").select("session_id")
    hits = found.where("action = 'halt_agent'").join(live, "session_id", "left_semi")
    return hits.groupBy("session_id").agg(F.min("event_id").alias("event_id"), F.min_by("rule_id", F.struct("event_id", "rule_id")).alias("rule_id"))


def approvals(found: DataFrame, rules: DataFrame, session: DataFrame, clients: list[int]) -> DataFrame:
    """J-03: the queue of what waits for approval, with the rule's and the session's columns, for some tenants."""
    waiting = found.where("action = 'require_approval'").drop("rule_name", "client_id", "action")
    own = session.where(F.col("client_id").isin(clients)).select("session_id", "client_id", "outcome")
    return waiting.join(F.broadcast(rules.select("rule_id", F.col("name").alias("rule_name"), "action")), "rule_id").join(own, "session_id")  # rules are few


def resolve(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """D-15: only pending rows take a resolution (approval_id, resolution)."""
    joined = queue.join(resolutions.select("approval_id", "resolution"), "approval_id", "left")
    return joined.withColumn("status", F.when(F.col("status") == "pending", F.coalesce("resolution", "status")).otherwise(F.col("status"))).drop("resolution")
