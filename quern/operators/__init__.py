"""DataFrame operators: grading, merging, summaries, linkage, parts, search and name parsing."""
