"""Lexers of programming languages, for the code graph and the text operators."""
