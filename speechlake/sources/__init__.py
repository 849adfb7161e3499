"""Readers and writers of manifests, predictions and scores."""
