"""Training-data operators: filters, deduplication, scoring and packing of document tables.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries`` binds the operators to the tables under fixed production parameters.
"""
