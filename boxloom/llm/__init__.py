"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
``entry`` registers the queries that apply them to whole tables.
"""
