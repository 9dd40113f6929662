"""Readers of workspaces and documents."""
