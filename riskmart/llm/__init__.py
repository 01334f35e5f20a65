"""Training-data operators over the ``documents`` table; nothing outside this subpackage imports it.

Every operator takes a DataFrame and column names, keeps to the columns it names (extra or clashing
columns are never read) and states in its docstring what nulls, empty texts, ties and repeated rows give.
"""
