from .trajectory import rank_announced_cameras, read_current_rankings

__all__ = ["rank_announced_cameras", "read_current_rankings"]
