"""Operators for preparing training data at scale.

Nothing else in the library imports this package. ``queries`` and ``oracles``
list what the driver contract registers.
"""
