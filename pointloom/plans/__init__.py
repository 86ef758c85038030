"""The index facade and its queries."""
