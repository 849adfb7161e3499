"""Training-data operators: thirteen corpus operators and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
