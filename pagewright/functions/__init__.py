"""Column expressions: everything here is JVM-side and codegen friendly."""
