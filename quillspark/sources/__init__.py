"""Readers and writers of the tables and files the jobs use."""
