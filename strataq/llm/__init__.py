"""Training-data operators: one module per operator, queries in ``registry``.

Nothing outside this folder imports it; deleting it leaves the rest whole.
"""
