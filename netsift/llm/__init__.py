"""Training-data operators over documents, pages and embeddings.

Every operator takes and returns DataFrames. Nothing else in the library
imports this subpackage.
"""
