"""Tables of the input folder and of the folder that the whole cluster shares, and names for new columns."""

from tessera.sources.tables import drop, new_path, read, shared_dir, store, temporary_tables

__all__ = ["drop", "new_path", "read", "shared_dir", "store", "temporary_tables", "unused"]


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores added until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
