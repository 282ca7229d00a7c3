"""Part of verispan; see the README for the layout."""
