"""touchline: a Spark-first engine for time-stamped speech transcripts.

Everything is expressed over DataFrames; nothing in the package outside
``touchline.llm`` imports ``touchline.llm``.
"""

__version__ = "0.1.0"
