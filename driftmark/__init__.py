"""driftmark: incremental analysis of versioned text corpora, on Spark DataFrames.

Subpackages: ``sources`` (readers), ``functions`` (column expressions), ``operators`` (DataFrame in,
DataFrame out), ``plans`` (registered queries with their SQL), ``streaming`` and the optional ``llm``.
"""

__version__ = "0.1.0"
