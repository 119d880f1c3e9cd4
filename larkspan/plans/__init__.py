"""From SQL text to a DataFrame: lexer, parser, binder, planner."""
