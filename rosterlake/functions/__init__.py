"""Column-level building blocks used by the jobs in ``operators``."""
