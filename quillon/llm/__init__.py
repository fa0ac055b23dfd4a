"""Training-data operators (ten of them). Nothing outside this subpackage imports it."""
