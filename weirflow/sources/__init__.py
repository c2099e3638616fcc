"""Readers of ordered lines and of formats that lines carry."""
