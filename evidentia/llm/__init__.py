"""Operators that prepare text corpora for language-model training.

Nothing outside this package imports it.  Every operator takes and returns DataFrames;
`evidentia.llm.registry` holds the registered queries and their SQL.
"""
