"""Spark-native analytics for reactive and coarse-grained particle trajectories.

Every public function takes and returns DataFrames (or Columns); nothing is
collected on the driver except convergence counts of the graph loops.
"""
