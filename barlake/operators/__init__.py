"""operators of barlake."""
