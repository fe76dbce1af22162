"""Requests, their compiler and the question language."""
