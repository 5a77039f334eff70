"""Registered queries over the test tables and the SQL each is checked against."""
