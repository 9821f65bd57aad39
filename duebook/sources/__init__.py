"""Readers, writers and the tables kept between runs."""
