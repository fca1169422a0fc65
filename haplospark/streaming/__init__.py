"""Traversals over operands that arrive as a stream."""
