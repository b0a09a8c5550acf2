"""The airfare analyses: thin configurations over the generic operators."""
