"""Document-stream curation on Spark: feeds in, a small trustworthy edition out."""
