"""Relational operators over tables of vectors."""
