"""Spark jobs for analytics data modelling and large text corpora."""
