"""All core queries and their SQL."""

from tessera.operators import queries_faces, queries_orphans, queries_people, queries_state, queries_vectors

_REGISTRIES = (queries_people.R, queries_state.R, queries_faces.R, queries_vectors.R)


def queries() -> dict:
    """Every core query by name."""
    return {k: f for r in _REGISTRIES for k, f in r.queries.items()} | queries_orphans.QUERIES


def oracle_sql() -> dict:
    """The SQL of the core queries."""
    return {k: s for r in _REGISTRIES for k, s in r.sql.items()} | queries_orphans.SQL
