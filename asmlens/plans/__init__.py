"""Whole workflows, the domain views of the driver tables, and the registered queries."""
