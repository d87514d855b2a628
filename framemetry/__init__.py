"""DataFrame operators for judging image restoration and classification experiments."""

__version__ = "0.1.0"
