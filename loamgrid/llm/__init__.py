"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL; the other modules hold the operators.
"""
