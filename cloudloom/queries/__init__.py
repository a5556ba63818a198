"""The registered queries on the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from . import evaluation, points, residues

QUERIES = {**points.QUERIES, **residues.QUERIES, **evaluation.QUERIES}
ORACLE = {**points.ORACLE, **residues.ORACLE, **evaluation.ORACLE}
