"""Part of stockweave."""
