"""Every image query and its SQL by name."""

from photonlake.plans import decoded, decoded_oracle, oracle, queries, rendered, rendered_oracle

QUERIES = queries.QUERIES | decoded.QUERIES | rendered.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | decoded_oracle.ORACLE_SQL | rendered_oracle.ORACLE_SQL
