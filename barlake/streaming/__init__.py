"""streaming of barlake."""
