"""Queries by domain: each is a lazy DataFrame program over a Source."""
