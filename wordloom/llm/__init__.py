"""Operators for large training-data pipelines over `documents`, `embeddings` and `pages`.

Nothing else in the library imports this subpackage; it may be removed
without touching the rest.  Every operator is a ``DataFrame -> DataFrame``
function; `q_llm` registers one query per operator.
"""
