"""Source-corpus analytics on Spark: scans, registries, usage analysis and their streaming form."""
