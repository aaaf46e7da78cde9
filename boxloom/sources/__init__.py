"""Readers: driver tables, label files, dataset descriptions and ledgers."""
