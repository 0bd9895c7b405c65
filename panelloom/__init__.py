"""Panel analytics on Spark DataFrames: long ``(date, ticker)`` tables in, long tables out."""
