"""Operators for preparing large training sets; nothing else in the package imports this one."""
