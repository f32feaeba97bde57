"""The workflow language: text to statements."""
