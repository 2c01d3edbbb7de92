"""Training-data operators: thirteen DataFrame operators and their registered queries.

Nothing outside this subpackage imports it; ``queries.py`` holds the entries
that ``__spark_entry__`` adds when the subpackage is present.
"""
