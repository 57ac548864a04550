"""Part of the relational engine; see README."""
