"""Runnable jobs: `python -m jobs.<name> --config jobs/<name>.json [--input ... --output ...]`."""
