"""Linguistic analytics over large text collections, as Spark plans."""
