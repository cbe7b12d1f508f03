"""News feature engineering on Spark: clean, score, embed, cluster, regress."""
