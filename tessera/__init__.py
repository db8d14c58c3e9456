"""Tessera: batch evidence analytics for drug repurposing, written as Spark jobs."""

__version__ = "0.1.0"
