"""The registered queries: name -> (Spark callable, SQL for the cross-check or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions import lookups as L
from .sql_views import VIEWS

QUERIES: dict[str, Callable] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn
    return add


def check_sql() -> dict[str, str]:
    """The check of every query that has one, with the views it names put in front."""
    return {name: with_views(sql) for name, sql in CHECK_SQL.items()}


def _view_text(name: str) -> str | None:
    if name.startswith("lk_") and name[3:] in L.TABLES:
        return L.values_sql(name[3:], "VARCHAR")
    return VIEWS.get(name)


def with_views(body: str) -> str:
    """Put a WITH clause in front of ``body`` holding every view it names, directly or through others."""
    order: list[str] = []

    def visit(text: str, path: tuple):
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            view = _view_text(name)
            if view is None or name in order or name in path:
                continue
            visit(view, path + (name,))
            order.append(name)

    visit(body, ())
    body = body.strip()
    ctes = [f"{n} AS ({_view_text(n).strip()})" for n in order]
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
