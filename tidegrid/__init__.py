"""tidegrid: time-series analytics over DataFrames of many series."""
