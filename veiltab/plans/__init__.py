"""Views over the driver tables, release recipes and audit recipes."""
