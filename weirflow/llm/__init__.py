"""Training-data operators: ten Spark jobs over ``documents`` and ``pages``.

Nothing else in the library imports this subpackage.
"""
