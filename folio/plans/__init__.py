"""Registered queries. Importing the package registers all of them."""

from folio.plans import answer_queries, catalog, question_queries, report_queries, source_queries  # noqa: F401
