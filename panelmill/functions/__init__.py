"""Column expressions: everything here is a built-in function composition, evaluated in the JVM."""
