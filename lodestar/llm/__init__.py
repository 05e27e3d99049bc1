"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``lodestar.llm.queries`` registers
the thin ``opN_`` queries over the provided tables.
"""
