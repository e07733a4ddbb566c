"""Names, callables and oracle SQL of every registered core query."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "audit_rates"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement, where SQL can express it."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    import importlib
    import pkgutil

    import lectorium.plans as plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name != "registry":
            importlib.import_module(f"lectorium.plans.{m.name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
