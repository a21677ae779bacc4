"""quarry: retrieval over large collections of source code and text, on Spark DataFrames.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from the public
DataFrame API so Catalyst can prune, push down and plan it.  Sub-packages:

* ``functions``  Column builders (paths, vectors, line splitting, ids).
* ``sources``    readers: driver tables, file trees, JSON documents, derived corpora.
* ``operators``  the operators (tree, sync, vectors, retrieval, blocks, edits, ...).
* ``plans``      query catalogue, DuckDB oracle SQL, plan inspection and guards.
* ``streaming``  Structured Streaming variants (continuous sync).
"""

__version__ = "0.1.0"
