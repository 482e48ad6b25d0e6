"""Part of halocline."""
