"""Readers and writers of the tables the operators exchange."""
