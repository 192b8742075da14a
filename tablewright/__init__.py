"""Spark-native cleaning, feature, profiling, KPI and driver-analysis operators for business tables."""
