"""What to do with a catalog: proposals, layouts, purge plans and account status."""
