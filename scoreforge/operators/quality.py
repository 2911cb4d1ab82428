"""Validation operators (P1-P6): constraint lists become one array of violation
codes per row, computed in a single projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


@dataclass(frozen=True)
class Range:
    """Numeric bound: ``ge`` / ``le`` inclusive, either may be None."""
    column: str
    ge: float | None = None
    le: float | None = None


@dataclass(frozen=True)
class Domain:
    column: str
    allowed: tuple


@dataclass(frozen=True)
class Required:
    column: str


@dataclass(frozen=True)
class Known:
    """Every value, null too, must be a key of the lookup that will be applied to the column."""
    column: str
    keys: tuple


Constraint = Range | Domain | Required | Known


def _checks(c: Constraint) -> list[Column]:
    x = F.col(c.column)
    if isinstance(c, Range):
        out = []
        if c.ge is not None:
            # NaN sorts above every number in Spark, but is in no range
            out.append(F.when((x < F.lit(c.ge)) | F.isnan(x.cast("double")), F.lit(f"{c.column}:ge")))
        if c.le is not None:
            out.append(F.when(x > F.lit(c.le), F.lit(f"{c.column}:le")))
        return out
    if isinstance(c, Domain):
        return [F.when(x.isNotNull() & ~x.isin(*c.allowed), F.lit(f"{c.column}:domain"))]
    if isinstance(c, Known):
        return [F.when(x.isNull() | ~x.isin(*c.keys), F.lit(f"{c.column}:unknown_key"))]
    if isinstance(c, Required):
        return [F.when(x.isNull(), F.lit(f"{c.column}:null"))]
    raise TypeError(c)


def violations(constraints: Sequence[Constraint]) -> Column:
    """P1/P2/P3 as one column: array of violation codes in constraint order."""
    checks = [chk for c in constraints for chk in _checks(c)]
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*checks))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """P3 schema part: required columns absent from the frame (metadata only)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def with_violations(df: DataFrame, constraints: Sequence[Constraint], name: str = "violations") -> DataFrame:
    require_columns(df, sorted({c.column for c in constraints}))
    return df.withColumn(name, violations(constraints))


def split_valid_invalid(df: DataFrame, constraints: Sequence[Constraint]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a ``reasons`` array)."""
    flagged = with_violations(df, constraints, "reasons")
    valid = flagged.where(F.size("reasons") == 0).drop("reasons")
    invalid = flagged.where(F.size("reasons") > 0)
    return valid, invalid


def project_drop(df: DataFrame, drop: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """P5: drop the target and/or keep a feature subset (pruned at the scan)."""
    out = df.drop(*drop)
    return out.select(*keep) if keep is not None else out


def fill_null(df: DataFrame, text_cols: Sequence[str] = (), cat_cols: Sequence[str] = (),
              text_default: str = "", cat_default: str = K.UNKNOWN_CATEGORY) -> DataFrame:
    """Null text -> '' and null category -> 'Unknown'; numerics untouched."""
    fill: dict[str, str] = {c: text_default for c in text_cols}
    fill.update({c: cat_default for c in cat_cols})
    return df.na.fill(fill) if fill else df


def case_constraints(domains: Mapping[str, Sequence[str]] | None = None) -> list[Constraint]:
    """The request schema of a business case: ranges, domains, required fields."""
    domains = domains or {
        "risk_category": K.RISK_CATEGORIES,
        "regulatory_status": K.REGULATORY_STATUSES,
        "compliance_level": K.COMPLIANCE_LEVELS,
    }
    # fixed values: numeric bounds of a case
    ranges = [
        Range("revenue", ge=0), Range("employee_count", ge=1), Range("years_in_business", ge=1),
        Range("credit_score", ge=300, le=850), Range("debt_to_equity_ratio", ge=0),
        Range("liquidity_ratio", ge=0), Range("market_share", ge=0, le=1),
        Range("customer_satisfaction", ge=0, le=100), Range("operational_efficiency", ge=0, le=100),
        Range("regulatory_violations", ge=0), Range("audit_score", ge=0, le=100),
    ]
    required = [Required(c) for c in [
        "risk_category", "region", "business_type", "regulatory_status", "compliance_level", "revenue",
        "employee_count", "years_in_business", "credit_score", "debt_to_equity_ratio", "liquidity_ratio",
        "market_share", "growth_rate", "profitability_margin", "customer_satisfaction",
        "operational_efficiency", "regulatory_violations", "audit_score", "description"]]
    return required + ranges + [Domain(c, tuple(v)) for c, v in domains.items()]
