"""Column-level helpers: numbers, text, labels. All are JVM built-ins."""
