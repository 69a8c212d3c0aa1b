"""Spark-native analytics over versioned corpora of software-defect evidence."""
