"""Runnable jobs over tables of text; each has a command line and a small configuration file."""
