"""Training-data operators.

Nothing outside this subpackage imports it.  ``QUERIES`` and ``ORACLE_SQL``
register the operators' thin queries; see ``registry.py``.
"""
