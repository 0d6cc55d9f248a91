"""Operators for preparing language-model training data.

Every operator takes a DataFrame and the names of the columns that it reads,
selects only those, and so is indifferent to extra columns of any name.
"""
