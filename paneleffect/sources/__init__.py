"""Readers and writers for panels, run tables, configs and models."""
