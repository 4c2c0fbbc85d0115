"""Numbers that decide scores.

Fixed values: a ranking is only comparable with others that use the same ones.
"""

VISIBLE_FACTOR = 1.0
HIDDEN_FACTOR = 0.01
DISTANCE_OFFSET = 0.001
LEVEL_BASE = 10.0
DEFAULT_LEVELS = 3

# Not part of the score. A camera with more rows (pairs x levels) than this is ranked
# over many tasks; any other camera is sorted by one task, which can spill.
ROWS_PER_TASK = 6_000_000

# Shuffle partitions are meant to hold this many rows: measured, sorting runs faster in
# small ones, and it spares memory.
ROWS_PER_PARTITION = 750_000

# Visible lists are kept in pages covering this many consecutive tile positions.
PAGE_TILES = 4096
