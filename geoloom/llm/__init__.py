"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; every other module holds one operator.
"""
