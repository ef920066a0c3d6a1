"""Relational operators: retrieval, ranking, evidence, grounding, citations, questions, evaluation, storage."""
