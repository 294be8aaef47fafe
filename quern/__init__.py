"""quern: Spark-native analytics over documents, vectors, tensors and event logs.

Every public operator takes and returns DataFrames; nothing here runs an action
unless its docstring says so.
"""

__version__ = "0.1.0"
