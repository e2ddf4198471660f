"""Reading folders, sidecars, dictionaries and caches; writing and file actions."""
