"""Column builders (pure expressions, JVM side, inside whole-stage codegen)."""
