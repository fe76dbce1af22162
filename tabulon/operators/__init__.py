"""Grid, reshape and quality operators over DataFrames."""
