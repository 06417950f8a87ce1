"""Unobserved inflow from noisy storage and outflow series, and the joins, audits and scores around it, as Spark jobs."""
