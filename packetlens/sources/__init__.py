"""Scans of capture text and flow CSV, feature-schema files and the shared work folder."""
