"""How whole-stream orders and the query catalogue are laid out."""
