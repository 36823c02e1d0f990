"""Script analytics on Spark: JavaScript rewriting, JavaScript scalar functions and the relations behind them."""
