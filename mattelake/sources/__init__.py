"""Readers: image folders, ledgers, histories."""
