"""Entity resolution on Spark DataFrames: native column expressions, posting tables, staged joins and a decision cascade."""
