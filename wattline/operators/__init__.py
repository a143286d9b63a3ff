"""DataFrame operators. All are lazy unless their docstring says that they write."""
