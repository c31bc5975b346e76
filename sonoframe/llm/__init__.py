"""Training-data operators for corpora of documents, pages and vectors.

Nothing outside this subpackage imports it.
"""
