"""Column functions: geometry and text measurement, all inside Catalyst."""
