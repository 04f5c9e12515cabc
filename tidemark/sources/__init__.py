"""Derived domain tables and the lake's readers and writers."""
