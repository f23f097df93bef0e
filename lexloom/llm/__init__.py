"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Every operator takes a
``SparkSession`` and DataFrames, keeps what it derives in the shared folder of
:mod:`lexloom.llm.store`, and states its defined results in its docstring.
"""
