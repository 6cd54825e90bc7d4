"""Operators for training text: each module is one problem, ``queries`` registers them."""
