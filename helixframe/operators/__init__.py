"""DataFrame operators: joins, metrics, splits, checks, cohort jobs."""
