"""DuckDB oracle SQL and the side-by-side checker."""


def all_sql() -> dict[str, str]:
    from . import oracle_drift, oracle_features, oracle_io, oracle_model, oracle_monitor  # noqa: F401
    from .oracle_sql import SQL
    return dict(SQL)
