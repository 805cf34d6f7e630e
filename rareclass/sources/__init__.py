"""Readers and writers: raw tables, prepared splits, run ledger, artifacts, models."""
