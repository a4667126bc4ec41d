"""The checks: each takes tables and returns tables, with ``repo`` as a key."""
