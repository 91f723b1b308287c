"""Scans, format sniffing, decoders, metadata readers and label files."""
