"""Training-data operators: quality, toxicity, near-duplicates, WARC, packing and tokens.

Nothing else in the package imports this subpackage. Every operator takes a DataFrame and
column names, and works on whole tables and whole texts.
"""
