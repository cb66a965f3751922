"""DataFrame operators: joins, aggregates, retrieval, text work and reports."""
