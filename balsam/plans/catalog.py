"""Importing this module registers every query."""

from . import queries_keys, queries_matching, queries_options, queries_people, queries_registry, queries_retrieval, queries_segmentation, queries_store, queries_tables  # noqa: F401
