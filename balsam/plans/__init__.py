"""Composed jobs and the registered queries over the driver tables."""
