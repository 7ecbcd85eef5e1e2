"""The script layer: statements, macros and the context they run in."""
