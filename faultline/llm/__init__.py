"""Operators for preparing training data.

Nothing outside this subpackage imports it; removing the folder leaves the rest working.
"""
