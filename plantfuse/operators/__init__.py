"""DataFrame operators. None collects rows, and none needs a user-defined function."""
