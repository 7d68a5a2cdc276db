"""Quality operators: DataFrame in, DataFrame out."""
