"""cohortloom: Spark-native analytics over long-read transcript cohorts."""

__version__ = "0.1.0"
