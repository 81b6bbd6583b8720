"""Panel harmonisation and group-disparity metrics as Spark DataFrame transformations."""
