"""Where files and vectors come from."""
