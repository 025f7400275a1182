"""A Spark-native engine for code-switched speech and text analytics.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns); nothing is collected to the driver inside an operator.
"""

__version__ = "0.1.0"
