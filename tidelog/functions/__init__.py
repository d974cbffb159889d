"""Column functions: built-in expressions only, unless a docstring says otherwise."""
