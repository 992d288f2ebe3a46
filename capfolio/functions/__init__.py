"""Column-to-Column helpers. Everything here stays in JVM expressions."""
