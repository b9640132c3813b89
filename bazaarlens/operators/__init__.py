"""Reusable DataFrame operators: grain control, ranking, cohorts, reconciliation, scorecards, skew."""
