"""Relational building blocks over the ``runs`` table."""
