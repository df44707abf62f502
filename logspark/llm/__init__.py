"""Operators of a training-data pipeline over whole documents, pages, embeddings and chats."""
