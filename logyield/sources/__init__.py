"""Inputs and outputs: log files, archives, upload manifests, batch tables."""
