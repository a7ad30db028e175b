"""Training-data operators. Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in ``__spark_entry__.py`` uses them."""
