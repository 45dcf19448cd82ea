"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage.
"""
