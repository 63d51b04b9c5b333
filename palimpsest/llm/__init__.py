"""Operators for preparing training data: one module per operator.

``queries.py`` binds each operator to its driver query; nothing outside this
subpackage imports it.
"""
