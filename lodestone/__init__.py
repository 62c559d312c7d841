"""Lodestone: a retrieval and corpus analytics engine written for Spark DataFrames."""
