"""ratecast: Spark-native analytics for dated, keyed rating/event tables.

Every operator is a plain ``DataFrame -> DataFrame`` function (or
``Column -> Column`` for scalars) whose column names are arguments.
"""

__version__ = "0.1.0"
