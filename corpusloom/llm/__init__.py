"""Operators for training data of language models; nothing outside this folder imports it."""
