"""File inventories, change feeds, version histories and snapshot stores as DataFrames."""
