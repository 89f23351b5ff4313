"""From query text to a DataFrame plan: lexer, parser, syntax tree, compiler."""
