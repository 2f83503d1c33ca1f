"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` wires them to the test tables.
"""
