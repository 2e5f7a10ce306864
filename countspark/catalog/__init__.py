"""All registered queries. Importing this package fills the registry."""

from countspark.catalog.registry import ORACLE, QUERIES, sql  # noqa: F401
from countspark.catalog import q_joins, q_models, q_norm, q_pairs, q_qc, q_sets, q_tables  # noqa: F401
