"""Training-data operators: ten corpus-preparation steps built on Spark.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries`` holds the thin registered queries.
"""
