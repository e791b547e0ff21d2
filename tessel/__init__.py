"""tessel: code analytics and semantic search as Spark DataFrames.

The core package holds the relational operators; the optional subpackage ``llm`` holds the
training-data operators and is imported by nothing else in this package.
"""

__version__ = "0.1.0"
