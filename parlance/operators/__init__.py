"""Operators: every public function here maps DataFrames to a DataFrame."""
