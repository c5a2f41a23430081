"""Risk scoring on Spark DataFrames: features, models, one-way analysis,
Shapley explanations and score monitoring."""
