"""Relational feature enrichment as Spark jobs: tables to triples, triples to vectors and features."""
