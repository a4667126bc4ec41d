"""The security scan over files as they arrive."""
