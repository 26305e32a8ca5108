"""Training-data operators. Nothing outside this subpackage, corpus_pipeline.py and __spark_entry__.py imports it."""
