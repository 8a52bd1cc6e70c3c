"""Resolves dirty bibliographic venue strings against keyed ranking catalogs, on PySpark."""
