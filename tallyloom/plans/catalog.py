"""The queries of the library and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from tallyloom.plans import audit_queries, bindings, comparison_queries, corpus_queries, report_queries, vector_queries, wording_queries  # noqa: F401

QUERIES, ORACLES = bindings.QUERIES, bindings.ORACLES
