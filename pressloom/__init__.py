"""Pressloom: news-corpus analytics on Spark."""
