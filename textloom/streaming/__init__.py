"""The index built from a stream of documents."""
