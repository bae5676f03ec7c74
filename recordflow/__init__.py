"""recordflow: record hygiene, joins, rollups and payment-event jobs as Spark DataFrames."""
