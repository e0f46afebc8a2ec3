"""Text-signal, memory and log analytics on Spark.

Everything is a ``DataFrame -> DataFrame`` transform or a function that
returns a ``Column``; nothing here starts a Spark session on import.
"""

__version__ = "0.1.0"
