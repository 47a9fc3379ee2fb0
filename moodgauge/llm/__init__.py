"""Operators of a training-data pipeline (see README, "llm").

Nothing outside this folder imports it; ``queries`` holds the registered
queries and ``sql`` their DuckDB twins.
"""
