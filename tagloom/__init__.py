"""Curation of tagged and captioned records as DataFrame operators."""
