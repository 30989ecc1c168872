"""Expressions over verdict columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import ACTIONS, RULE_LABELS, SEVERITY


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as one CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def severity(verdict: Column) -> Column:
    return lookup(verdict, SEVERITY, 0)


def action(verdict: Column) -> Column:
    return lookup(verdict, ACTIONS, "pass")


def alert_label(flags: Column, rf_label: Column) -> Column:
    """Display name of the first fired rule that has one, else the classifier label."""
    named = F.filter(
        F.transform(flags, lambda f: lookup(F.substring_index(f, ":", 1), RULE_LABELS)),
        lambda name: name.isNotNull(),
    )
    return F.coalesce(F.get(named, F.lit(0)), rf_label)


def alert_source(source: Column) -> Column:
    """Source without rule prefixes, at most 16 characters."""
    return F.substring(F.replace(source, F.lit("_rule_"), F.lit("")), 1, 16)


def rule_suffix(flags: Column) -> Column:
    """Comma-joined flags, each cut before its detail in parentheses."""
    return F.array_join(F.transform(flags, lambda f: F.substring_index(f, "(", 1)), ",")


def in_verdict_list(verdict: Column, verdicts: str) -> Column:
    """Membership in a comma-separated verdict list."""
    return verdict.isin([v.strip() for v in verdicts.split(",") if v.strip()])
