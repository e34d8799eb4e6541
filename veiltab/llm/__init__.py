"""Operators for preparing training text at corpus scale; ``queries`` lists what they register."""
