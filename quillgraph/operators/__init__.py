"""Operators over content graphs: trees of pages, their children, bodies and revisions."""
