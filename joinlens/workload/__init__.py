"""Workload of the engine."""
