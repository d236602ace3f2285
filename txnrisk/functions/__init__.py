"""Column expressions shared by every layer."""
