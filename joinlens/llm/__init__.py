"""Preparation of training corpora; nothing outside this subpackage imports it."""
