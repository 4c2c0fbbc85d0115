from .tables import (
    preview,
    read_cameras,
    read_mask,
    read_tiles,
    save_mask_by_camera,
    write_ranking,
)
from .workspace import checkpoint_folder, scratch_path, stored, workspace

__all__ = [
    "checkpoint_folder",
    "preview",
    "read_cameras",
    "read_mask",
    "read_tiles",
    "save_mask_by_camera",
    "scratch_path",
    "stored",
    "workspace",
    "write_ranking",
]
