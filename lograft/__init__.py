"""Spark-native planning, archiving and auditing of large log-file collections."""
