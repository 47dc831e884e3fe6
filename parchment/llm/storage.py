"""Tables that cut lineage, written where every executor and the driver can read them."""

from parchment.runtime import materialize, new_path, shared_dir

__all__ = ["materialize", "new_path", "shared_dir"]
