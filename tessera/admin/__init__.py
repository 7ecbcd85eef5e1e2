"""Authorisation, error texts, suggestions and shell access."""
