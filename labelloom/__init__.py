"""labelloom: plan, audit, ingest, gate, merge and monitor labelling datasets on Spark.

Every public function takes and returns DataFrames covering *all* shards and
iterations at once; a shard is a column, never a unit of execution.
"""

__version__ = "0.1.0"
