"""riskloom: transaction risk analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    schemas, readers/writers, derived fixture views over the test tables
functions  scalar column expressions (time, value, encoding, scoring bands)
operators  joins, windows, aggregates, data quality, preparation, models, metrics
plans      composed jobs: feature builds, training, scoring, the query catalog
streaming  Structured Streaming scoring, stateful velocity, alert windows
"""

__version__ = "0.1.0"
