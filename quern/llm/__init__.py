"""Operations of a training-data pipeline, each a Spark job over a table of documents.

Nothing outside this folder imports it; ``queries.py`` lists what it offers to the entry file.
"""
