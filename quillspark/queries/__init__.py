"""Registered queries and their SQL."""

from quillspark.queries import clinical, contracts, problems, structure, texts, values

MODULES = [problems, texts, values, structure, clinical, contracts]
