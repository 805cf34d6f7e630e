"""Spark jobs for labelled tables in which one class is very rare."""
