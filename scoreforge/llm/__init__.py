"""Operators for preparing language-model training data, on Spark.

Nothing else in the library imports this subpackage; its queries are in
``queries.py`` and are added by ``__spark_entry__.py`` when it can be imported.
"""
