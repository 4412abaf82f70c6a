"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``__spark_entry__.py`` registers the
queries of :mod:`recallspark.llm.queries` only when it can be imported.
"""
