"""Column expressions shared by the operators; every one is a JVM-side built-in."""
