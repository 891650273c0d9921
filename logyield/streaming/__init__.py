"""The batch jobs applied to arriving files and rows."""
