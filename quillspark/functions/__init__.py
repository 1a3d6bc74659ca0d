"""Column-in, column-out building blocks; all of them stay inside the JVM."""
