"""Retail price intelligence on Spark: catalog, prices, competitors, sales, alerts and matching as DataFrame functions."""
