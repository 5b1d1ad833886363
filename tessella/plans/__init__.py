"""Query language: lexer, parser, syntax tree, planner."""
