"""sources of barlake."""
