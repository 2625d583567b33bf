"""Spark-native extraction, crawl analytics and corpus preparation."""
