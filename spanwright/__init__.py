"""Span analytics on Spark: detection, anonymisation, corpus building and scoring of character spans."""
