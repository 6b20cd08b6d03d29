"""Readers and writers for tables and stored models."""
