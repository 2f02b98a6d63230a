"""Spatial scaling of choice data (actor, item, yes/no/absent, period) on Spark."""

__version__ = "0.1.0"
