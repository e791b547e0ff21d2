"""Column functions: paths, text, keys, vectors. All of them stay inside the JVM unless said otherwise."""
