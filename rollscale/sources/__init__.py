"""Readers and writers for vote tables, parameter tables and run outputs."""
