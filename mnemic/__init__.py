"""mnemic: a PySpark-native engine for an evolving, provenance-aware graph memory.

State is a set of DataFrame snapshots (entities, aliases, edges, documents, hierarchy); every
operation is a DataFrame transform. The subpackage ``llm`` holds operators for training-data
pipelines and is not imported from anywhere else in the library.
"""

__version__ = "0.1.0"
