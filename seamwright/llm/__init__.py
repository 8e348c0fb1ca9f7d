"""Operators for building text and code training corpora.

Nothing outside this subpackage imports it; it may use the core library.
"""
