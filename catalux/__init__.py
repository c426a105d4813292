"""catalux — a Spark-native catalogue search and indexing library.

Every operator is a function ``DataFrame(s) -> DataFrame`` or
``Column -> Column``.  Catalyst plans the work; Python runs inside tasks
only for vector scoring and embedding (Arrow batches).
"""

__version__ = "0.1.0"
