"""Operators for large language-model data: nothing outside this subpackage imports them."""
