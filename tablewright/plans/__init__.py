"""Whole pipelines: cleaning, feature derivation, KPI suite."""
