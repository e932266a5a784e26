"""Crawl and link analytics as plain functions from DataFrames to DataFrames."""
