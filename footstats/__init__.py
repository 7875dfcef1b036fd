"""footstats: recorded-footage analytics as DataFrame -> DataFrame functions on Spark.

* ``functions``  column expressions (paths, clock text, boxes, arrays, labels)
* ``operators``  DataFrame operators (ordered sequences, intervals, joins, statistics, features)
* ``sources``    readers, writers and the staging of intermediate tables
* ``plans``      whole flows built from the operators
* ``streaming``  which of the functions may be used on an unbounded input

The caller owns the session; nothing here creates or stops one.
"""
