"""Column expressions and list functions over the candidates of one query."""
