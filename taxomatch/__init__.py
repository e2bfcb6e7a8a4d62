"""taxomatch: match free-text records to a reference taxonomy on Spark.

Every public function takes and returns DataFrames. Sub-packages:

- ``functions``: column expressions (text cleaning, tokens, stemming, vectors).
- ``sources``: scans, sinks, the weights file and the vector cache.
- ``operators``: knowledge-base build, label preparation, lexical scoring,
  matching, evaluation, reports and encoders.
- ``plans``: the query catalogue over the driver tables and its SQL oracle.
- ``streaming``: stream-static matching with Structured Streaming.
"""

from taxomatch.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
