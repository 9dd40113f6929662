"""Change streams of a workspace."""
