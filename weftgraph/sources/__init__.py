"""Readers: tables, solutions, source files and stored graphs."""
