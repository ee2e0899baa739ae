"""Brookfern: retrieval, text analytics and corpus operators expressed as Spark plans."""
