"""Grouped binary classification on DataFrames."""
