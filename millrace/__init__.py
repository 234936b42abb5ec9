"""Curation of training corpora as Spark plans."""
