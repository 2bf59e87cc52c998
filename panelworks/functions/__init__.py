"""Column expressions: they take and return ``Column`` and run inside codegen."""
