"""Column-level building blocks; everything here stays on the JVM side."""
