"""Whole plans: benchmark, answers, stress test, and the query catalogue."""
