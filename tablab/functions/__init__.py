"""Column-level helpers shared by the operators (all JVM-side expressions)."""
