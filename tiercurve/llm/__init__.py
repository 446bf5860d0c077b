"""Operators that clean and pack a corpus of documents for language-model training."""
