"""quern: a Spark-native engine for querying collections of documents and files."""

from quern import ship

ship.by_value()
