"""Column-expression helpers (dialect semantics, ordered string aggregation)."""
