"""Bibliometric analytics on Spark."""
