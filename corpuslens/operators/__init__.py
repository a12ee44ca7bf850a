"""Search and report operators: DataFrames in, DataFrames out."""
