"""Stateful dataflows out of DataFrames: ordered atomic batches, keyed state, services and loops."""
