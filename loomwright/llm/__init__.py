"""Operators for preparing training corpora: dedup, language, tokens, archives, privacy and packing.

Nothing outside this subpackage imports it.
"""
