"""Label and document compliance analytics as plain DataFrame operators."""
