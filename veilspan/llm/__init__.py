"""Training-data operators: the numbered queries and their shared parts.

Nothing outside this subpackage imports it.
"""
