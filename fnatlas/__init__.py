"""Spark jobs over catalogs of compiled-function records."""
