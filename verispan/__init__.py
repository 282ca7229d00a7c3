"""verispan: claim-level reliability analytics expressed as Spark plans."""
