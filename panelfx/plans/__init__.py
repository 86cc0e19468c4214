"""End-to-end stages built from the operators: compile, smooth, estimate."""
