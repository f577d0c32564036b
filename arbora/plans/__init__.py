"""Query text to DataFrames: lexer, parser, compiler."""
