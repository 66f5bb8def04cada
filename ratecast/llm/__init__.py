"""Training-data pipeline operators (see the README's table of the ten)."""
