"""Whole lifecycles: ingest, governed read, archive listing."""
