"""Registration of queries with their SQL."""

from collections.abc import Callable


class Registry:
    """Collects the queries of a module; ``@registry.query(sql)`` registers a function under its name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register
