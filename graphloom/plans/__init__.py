"""Part of graphloom: plans."""
