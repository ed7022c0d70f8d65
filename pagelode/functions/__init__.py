"""Column functions: pure expressions that Catalyst can fold, push and compile."""
