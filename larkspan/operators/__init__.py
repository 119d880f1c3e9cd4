"""Relational operators as a host-language API; the planner uses the same ones."""
