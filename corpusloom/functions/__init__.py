"""Column functions: everything here maps Columns to Columns and works on streams too."""
