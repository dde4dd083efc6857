"""Training-data operators: ten operators over documents, embeddings and pages.

Nothing else in the package imports this one. Each module holds one operator with its own
interface; ``queries`` binds them to the provided tables.
"""
