"""Typed-triple graph analytics on Spark."""
