"""Operators for building language-model training corpora.

One module per operator; ``queries.py`` registers them. Nothing else in the
library imports this subpackage.
"""
