"""Cohort and multi-omics analytics as Spark DataFrame operators."""
