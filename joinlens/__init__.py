"""Spark-native study of join queries: sub-plan sizes, estimators, plan quality, and corpus preparation."""
