"""Part of graphloom: streaming."""
