"""Queries of the training-data operators and their SQL."""

from tessera.llm import q_abuse, q_capping, q_clusters, q_encoding, q_mixing, q_names, q_neighbours, q_subset

_MODULES = (q_names, q_neighbours, q_subset, q_clusters, q_capping, q_encoding, q_mixing, q_abuse)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
