"""Native Column expressions; nothing here starts a Python worker."""
