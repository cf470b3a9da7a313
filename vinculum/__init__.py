"""Biomedical knowledge-graph analytics on PySpark.

``sources``    readers and writers (XML, CSV, SDF text, parquet)
``functions``  column expressions, keep-one-per-key and top-k helpers
``operators``  DataFrame -> DataFrame graph, taxonomy and retrieval operators
``plans``      whole pipelines: drug table, taxonomy, graph build, retrieval
"""
