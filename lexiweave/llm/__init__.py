"""Training-data operators.

Ten operators for corpora of documents, pages and embeddings.  Nothing else in
the library imports this subpackage; ``queries`` holds their registered queries.
"""
