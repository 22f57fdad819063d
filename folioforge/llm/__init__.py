"""Operators for preparing training text: language, duplicates, contamination, mixing, safety and scoring.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
``queries`` binds them to the tables of a data folder.
"""
