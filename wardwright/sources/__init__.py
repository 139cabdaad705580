"""Readers, bindings, inline sources and sinks."""
