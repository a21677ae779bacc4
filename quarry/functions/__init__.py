"""Column builders: pure expressions, JVM-side, usable in any select/filter."""
