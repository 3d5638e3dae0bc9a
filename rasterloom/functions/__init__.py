"""Scalar functions as Column builders, so that Catalyst sees through them."""
