"""Training-data operators: dedup, scoring, classification, extraction, mixing.

Each module holds one operator with its own general interface; ``queries``
binds them to the tables of a data folder.  Nothing outside this subpackage
imports it.
"""
