"""A document-intelligence engine on Spark: pages, blocks, tables and citations as DataFrames."""
