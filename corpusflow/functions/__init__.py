"""Column functions: text in, text or a small structure out. Everything stays in the JVM."""
