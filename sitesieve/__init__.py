"""Site analytics on Spark: DataFrame operators over page, link, keyword, result and run tables."""
