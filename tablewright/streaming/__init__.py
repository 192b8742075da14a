"""The row-level cleaning rules on a streaming table."""
