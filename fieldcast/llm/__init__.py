"""Operators for preparing language-model training data.

Nothing outside this package imports it. ``queries`` registers one query per
operator; each operator module has its own general interface.
"""
