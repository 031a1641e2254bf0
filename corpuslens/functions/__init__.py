"""Column expressions: text cleaning, tokens, repeatable hashing."""
