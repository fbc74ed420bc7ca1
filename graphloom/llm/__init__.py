"""Training-data operators: ten corpus operators over a ``documents`` table.

Nothing else in the library imports this subpackage.
"""
