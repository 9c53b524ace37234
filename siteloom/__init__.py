"""siteloom: DataFrame operators for insertion-site analytics on Spark."""
