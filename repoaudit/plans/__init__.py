"""The whole audit and its reports."""
