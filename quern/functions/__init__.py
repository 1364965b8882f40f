"""Column functions: text folding, price and availability text, URLs."""
