"""Tables that cut lineage; see ``docloom.storage``."""

from docloom.storage import drop, materialise, materialise_sorted, new_path, shared_folder

__all__ = ["drop", "materialise", "materialise_sorted", "new_path", "shared_folder"]
