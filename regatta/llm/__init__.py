"""Training-data operators: thirteen numbered operators and what they share.

Nothing outside this subpackage imports it; ``queries`` holds the thin
``opN_<name>`` queries and the operators live one module each.
"""
