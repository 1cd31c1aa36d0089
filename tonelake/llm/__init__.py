"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; ``tonelake.llm.queries`` registers its queries.
"""
