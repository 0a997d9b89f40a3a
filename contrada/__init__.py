"""Contrada: urban-risk data jobs as Spark DataFrame transformations."""
