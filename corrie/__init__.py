"""Topology of scalar fields on dense grids, and training-data operators, as Spark DataFrame plans."""

from pathlib import Path


def docs_path() -> Path:
    """The folder of the guides that come with the library."""
    found = Path(__file__).resolve().parent / "guide"
    if not found.is_dir():
        raise FileNotFoundError(f"the guides are not installed: {found}")
    return found
