"""Training-data operators: dedup, scoring, formatting, scanning, mixing.

Nothing else in the package imports this subpackage.
"""
