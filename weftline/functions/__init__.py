"""Column functions: text, urls, xpaths and vectors. All stay inside the JVM."""
