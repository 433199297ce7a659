"""Column functions: rounding, angles, geodesy, rotations, text keys."""
