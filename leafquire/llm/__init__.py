"""Jobs that prepare training text: one module for each operator.

Nothing else in the library imports this subpackage.
"""
