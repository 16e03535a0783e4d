"""Column roles, found from names alone. No job runs here except to emit a small table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from paneleffect import config
from paneleffect.config import Roles


def roles_of(column: str) -> set[str]:
    """All roles a column's name fits. What is suggested is not done: a suggestion is no action."""
    name = column.lower()
    fits = {role for role, fragments in config.ROLE_FRAGMENTS.items() if any(f in name for f in fragments)}
    return fits - {"action"} if "suggestion" in fits else fits


def detect_roles(columns: Sequence[str]) -> Roles:
    """Give every column its roles; time, customer and rep are the first column that fits."""
    by_role: dict[str, list[str]] = {role: [] for role in config.ROLE_FRAGMENTS}
    for column in columns:
        for role in roles_of(column):
            by_role[role].append(column)
    missing = [role for role, found in by_role.items() if not found]
    if missing:
        hints = "; ".join(f"{role} ({', '.join(config.ROLE_FRAGMENTS[role])})" for role in missing)
        raise ValueError(f"The panel has no column named like: {hints}.")
    several = [tuple(by_role[role]) for role in ("suggestion", "action", "outcome")]
    return Roles(*several, *[by_role[role][0] for role in ("time", "hcp", "rep")])


# Names of the roles in stored summaries.
STORED_ROLES = ("suggestion_cols", "action_cols", "outcome_cols", "time_col", "hcp_id_col", "rep_id_col")


def roles_dict(roles: Roles) -> dict:
    values = (getattr(roles, f.name) for f in fields(roles))
    return {name: list(v) if isinstance(v, tuple) else v for name, v in zip(STORED_ROLES, values, strict=True)}


def roles_table(spark: SparkSession, roles: Roles) -> DataFrame:
    """(role, position, column), positions from 1."""
    groups = {
        "suggestion": roles.suggestions,
        "action": roles.actions,
        "outcome": roles.outcomes,
        "time": (roles.time,),
        "hcp": (roles.hcp,),
        "rep": (roles.rep,),
    }
    rows = [(r, i, c) for r, names in groups.items() for i, c in enumerate(names, 1)]
    return spark.createDataFrame(rows, "role string, position int, column string")


def theme_columns(columns: Sequence[str], suggestion_type: str) -> list[str]:
    """Columns that count suggestions of one theme."""
    marker = "triggered_emails_ho_np" if suggestion_type == "npp" else "qualified"
    return [c for c in columns if "theme" in c and marker in c]


def outcome_columns(roles: Roles) -> tuple[str, str]:
    """The total and the new-to-brand prescription column; the latter falls back to the former."""
    trx = next((c for c in roles.outcomes if "trx" in c.lower()), None)
    if trx is None:
        raise ValueError("No outcome column has 'trx' in its name.")
    return trx, next((c for c in roles.outcomes if "nbrx" in c.lower()), trx)


def covariates_to_drop(suggestion_type: str, action_type: str, extra: dict | None = None) -> list[str]:
    table = config.COVARIATES_TO_DROP if extra is None else extra
    return list(table.get((suggestion_type, action_type), ()))


def drop_excluded_covariates(df: DataFrame, suggestion_type: str, action_type: str) -> DataFrame:
    """Leave out the covariates listed for this pair, whatever the case of their names."""
    unwanted = {c.lower() for c in covariates_to_drop(suggestion_type, action_type)}
    return df.drop(*[c for c in df.columns if c.lower() in unwanted])


def drop_rep_covariates(df: DataFrame) -> DataFrame:
    """Leave out covariates of the rep, before reps are collapsed."""
    unwanted = {c.lower() for c in config.REP_LEVEL_COVARIATES}
    return df.drop(*[c for c in df.columns if c.lower() in unwanted])


def matching(columns: Iterable[str], patterns: Sequence[str]) -> list[str]:
    compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
    return [c for c in columns if any(p.match(c) for p in compiled)]


def prefer_adstock(features: Sequence[str]) -> list[str]:
    """Where ``x_adstock`` is a feature, the raw ``x`` is not."""
    covered = {c[: -len("_adstock")] for c in features if c.endswith("_adstock")}
    return [c for c in features if c not in covered]
