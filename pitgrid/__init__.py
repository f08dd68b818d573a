"""pitgrid: point-in-time panel analytics on Spark DataFrames."""
