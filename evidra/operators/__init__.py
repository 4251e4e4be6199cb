"""Relational, statistical and record-linkage operators."""
