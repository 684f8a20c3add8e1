"""millrace: dataset curation written with Spark DataFrames.

The sub-packages hold scans and normalisers (``sources``), row-wise columns
(``functions``), relational operators (``operators``), export and routing plans
(``plans``) and Structured Streaming jobs (``streaming``).  The training-data
operators live apart, in ``llm``.
"""
