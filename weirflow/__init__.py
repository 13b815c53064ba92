"""Declarative partial replication on Spark: stream definitions to buckets, lookups, operation logs and checkpoints."""
