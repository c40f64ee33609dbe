"""Operators for preparing text corpora: language identification, deduplication, sharding,
archives, quality rules, decontamination, secrets, personal data and mixing.

Nothing else in the library imports this subpackage; it can be removed without
touching the rest.
"""
