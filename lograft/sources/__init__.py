"""Data sources and sinks.

Modules that run on executors are pickled by value, so that a cluster needs no
copy of this package on its workers.
"""
