"""Operators for preparing language-model training data.

Each module holds one operator with its general interface; ``queries`` registers
them over the driver tables. Nothing else in the library imports this package.
"""
