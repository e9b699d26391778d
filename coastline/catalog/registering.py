"""How the catalogue's modules collect their queries."""

from __future__ import annotations


def register_into(queries: dict, oracles: dict):
    """A decorator that registers a function by its name, with its SQL if there is any."""

    def query(oracle: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if oracle is not None:
                oracles[f.__name__] = oracle
            return f

        return register

    return query
