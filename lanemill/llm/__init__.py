"""Training-data operators: ten building blocks over a ``documents`` table.

Nothing else in the library imports this subpackage.
"""
