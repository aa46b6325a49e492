"""Column functions; Python is used only where bytes or quoting rules need it."""
