"""Tree model and recipes."""
