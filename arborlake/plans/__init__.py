"""Whole plans: the analysis run, the views over the supplied tables and the query catalogue."""
