"""functions of barlake."""
