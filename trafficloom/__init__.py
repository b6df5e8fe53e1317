"""Scene-graph analytics on Spark DataFrames: timelines, observations, relations, tracks, metrics and reviews."""
