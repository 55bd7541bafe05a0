"""Operators over streams of atoms."""
