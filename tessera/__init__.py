"""Batched pattern matching, rewriting and scheduling over typed relational worlds, on PySpark."""
