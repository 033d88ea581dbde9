"""Operators for preparing training data; nothing else in touchline imports this."""
