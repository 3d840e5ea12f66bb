"""Operators for preparing training text: rules, near copies, packing, formats, mixing."""
