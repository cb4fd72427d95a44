"""Table-at-a-time operators: DataFrame in, DataFrame out, no actions."""
