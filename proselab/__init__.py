"""proselab: Spark-native text evaluation, generation orchestration and
usage analytics.  Operators are plain ``DataFrame -> DataFrame`` functions
(chain them with ``df.transform``) and ``Column -> Column`` functions."""

__version__ = "0.1.0"
