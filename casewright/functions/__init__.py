"""Part of the case analytics library."""
