"""Operators for preparing training text: tokens, quality, copies, personal data, packing, pages."""
