"""Listing normalization on Spark: messy product texts in, typed clean tables out."""
