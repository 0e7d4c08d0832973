"""Operators for preparing training text: one module each, their queries in ``llm.queries``.

Nothing outside this package imports it.
"""
