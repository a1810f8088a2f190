"""Query plans: operators composed over tables, and their registry."""
