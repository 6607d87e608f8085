"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; :mod:`framewise.llm.queries` registers
one query for each of them.
"""
