"""Portfolio risk analytics as Spark DataFrame operators over many portfolios at once."""
