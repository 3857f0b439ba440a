"""Spark jobs for tabular learning with quantised ensembles."""
