"""Column functions: keys, imaging, potentials, bases."""
