"""Queries over the operators, and the SQL they are held against."""
