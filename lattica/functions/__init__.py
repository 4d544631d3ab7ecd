"""Column expressions: typing and cleaning, text, vectors."""
