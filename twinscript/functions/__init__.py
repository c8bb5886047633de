"""Column expressions over text; all of them stay inside the JVM."""
