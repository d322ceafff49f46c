"""Workflow analytics on Spark: command logs, queues, leases, events and DAG runs as DataFrames."""
