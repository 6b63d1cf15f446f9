"""Training-data operators: the ten corpus operators and their helpers.

Nothing outside this subpackage (but ``__spark_entry__.py`` and
``corpus_pipeline.py``) imports it.
"""
