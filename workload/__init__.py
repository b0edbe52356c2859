"""Queries over the given tables, each with the SQL that says the same.

Every module holds ``QUERIES`` (name -> function of session and folder) and ``SQL``
(name -> statement over the tables of the same names).
"""
