"""Training-data operators (documents, web archives, tokens) on Spark.

Nothing outside this folder imports it, apart from the guarded registration
in ``__spark_entry__`` and ``corpus_pipeline``.
"""
