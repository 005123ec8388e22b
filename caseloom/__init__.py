"""Case-graph analytics as ordinary Spark jobs."""
