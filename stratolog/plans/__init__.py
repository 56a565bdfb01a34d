"""Manifest and table handle: the control plane."""
