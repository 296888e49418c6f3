"""Operators on time-coded tables: DataFrame in, DataFrame out, one recording a key."""
