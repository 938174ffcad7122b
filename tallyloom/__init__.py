"""tallyloom: invoice-ledger processing as Spark jobs, DataFrames in and DataFrames out."""
