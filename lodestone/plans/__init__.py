"""Registered queries over the driver tables and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

#: name -> function of (spark, sf_dir); filled by ``register``.
QUERIES: dict[str, Callable] = {}
#: name -> DuckDB SQL for the same rows.
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator that files a query under ``name``, with its SQL where SQL can say it."""

    def keep(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return keep
