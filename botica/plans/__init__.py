"""Named queries: library operators applied to whole tables, each with its SQL twin."""
