"""Strain-catalog analytics on Spark: catalogs, leakage-free splits, pairs, audits and spectral arrays."""
