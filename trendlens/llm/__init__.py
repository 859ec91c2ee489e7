"""Training-data preparation operators on Spark.

One module per operator (see README, "Training-data operators"); ``queries``
registers one query per operator and their DuckDB texts. Nothing outside this
folder, ``corpus_pipeline.py`` and ``__spark_entry__.py`` imports it.
"""
