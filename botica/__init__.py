"""Pharmacy retail analytics as Spark jobs.

Every public function takes DataFrames and returns DataFrames; sinks and streams
are the only functions that start Spark jobs.
"""
