"""Registration of queries with their SQL."""

from __future__ import annotations

from . import views as V


class Registry:
    """Queries of one module and their SQL, filled by decorating functions."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, names: str, body: str):
        def register(f):
            self.queries[f.__name__] = f
            self.sql[f.__name__] = V.sql(names, body) if names else body
            return f

        return register

    def rows_only(self, f):
        """For queries that SQL can't express."""
        self.queries[f.__name__] = f
        return f
