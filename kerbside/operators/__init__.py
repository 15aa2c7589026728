"""Distributed operators over doors, streets and faces."""
