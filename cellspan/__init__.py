"""Versioned sparse cells on Spark: scans, filters, mutations and batch jobs."""
