"""Contract-clause analytics on Spark DataFrames.

``functions``  Column -> Column expressions (text, language, readability, scoring)
``operators``  DataFrame -> DataFrame building blocks (joins, aggregates, windows, dedup)
``sources``    readers and writers
``plans``      end-to-end jobs composed from the above
``streaming``  Structured Streaming versions of the incremental jobs
``ml``         clause classifiers on Spark ML
"""
