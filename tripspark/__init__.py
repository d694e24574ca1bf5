"""Spark jobs over vehicle trip data: drives, driver assist, charging, imports."""
