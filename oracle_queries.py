"""SQL for the registered queries, over the given tables, for a single-node engine."""

from __future__ import annotations

# Common table expressions; a query lists those it builds on.
_CTES = {
    "tiles": """
        tiles AS (
          SELECT p_partkey AS tile_index, p_partkey + 1000 AS tile_idx,
                 p_size::DOUBLE / 8::DOUBLE AS lx,
                 floor(p_retailprice)::DOUBLE / 8::DOUBLE AS ly,
                 length(p_name)::DOUBLE / 8::DOUBLE AS lz,
                 p_size::DOUBLE / 8::DOUBLE + 0.5::DOUBLE AS hx,
                 floor(p_retailprice)::DOUBLE / 8::DOUBLE + 0.25::DOUBLE AS hy,
                 length(p_name)::DOUBLE / 8::DOUBLE
                   + length(p_type)::DOUBLE / 8::DOUBLE AS hz
          FROM part)""",
    "cameras": """
        cameras AS (
          SELECT s_suppkey AS camera_uid, -s_suppkey AS camera_ord,
                 s_nationkey::DOUBLE / 4::DOUBLE AS px,
                 floor(s_acctbal)::DOUBLE / 64::DOUBLE AS py,
                 s_nationkey::DOUBLE / 8::DOUBLE AS pz
          FROM supplier)""",
    "mask": """
        mask AS (
          SELECT l_suppkey AS camera_uid, l_partkey AS tile_index,
                 bool_or(l_linestatus = 'O') AS visible
          FROM lineitem GROUP BY l_suppkey, l_partkey)""",
    "pairs": """
        pairs AS (
          SELECT m.camera_uid, m.tile_index, t.tile_idx, m.visible,
                 (t.lx + t.hx) / 2::DOUBLE - c.px AS dx,
                 (t.ly + t.hy) / 2::DOUBLE - c.py AS dy,
                 (t.lz + t.hz) / 2::DOUBLE - c.pz AS dz
          FROM mask m JOIN tiles t USING (tile_index) JOIN cameras c USING (camera_uid))""",
    "measured": """
        measured AS (
          SELECT camera_uid, tile_index, tile_idx, visible,
                 sqrt(dx * dx + dy * dy + dz * dz) AS distance
          FROM pairs)""",
    "embedded": """
        boxes AS (
          SELECT vec_id AS tile_index, vec_id + 1000 AS tile_idx,
                 least(embedding[1]::DOUBLE, embedding[4]::DOUBLE) AS lx,
                 least(embedding[2]::DOUBLE, embedding[5]::DOUBLE) AS ly,
                 least(embedding[3]::DOUBLE, embedding[6]::DOUBLE) AS lz,
                 greatest(embedding[1]::DOUBLE, embedding[4]::DOUBLE) AS hx,
                 greatest(embedding[2]::DOUBLE, embedding[5]::DOUBLE) AS hy,
                 greatest(embedding[3]::DOUBLE, embedding[6]::DOUBLE) AS hz
          FROM embeddings),
        embedded AS (
          SELECT tile_index, tile_idx, (lx + hx) / 2::DOUBLE AS cx,
                 (ly + hy) / 2::DOUBLE AS cy, (lz + hz) / 2::DOUBLE AS cz
          FROM boxes)""",
    "embedded_first": """
        camera AS (
          SELECT vec_id AS camera_uid, embedding[7]::DOUBLE AS px,
                 embedding[8]::DOUBLE AS py, embedding[9]::DOUBLE AS pz
          FROM embeddings ORDER BY vec_id LIMIT 1),
        measured AS (
          SELECT camera_uid, tile_index, tile_idx, cx > px AS visible,
                 sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)
                      + (cz - pz) * (cz - pz)) AS distance
          FROM embedded, camera)""",
    "first": """
        camera AS (SELECT * FROM cameras ORDER BY camera_ord LIMIT 1),
        measured AS (
          SELECT camera_uid, tile_index, tile_idx, visible,
                 sqrt(dx * dx + dy * dy + dz * dz) AS distance
          FROM (
            SELECT c.camera_uid, t.tile_index, t.tile_idx,
                   coalesce(m.visible, false) AS visible,
                   (t.lx + t.hx) / 2::DOUBLE - c.px AS dx,
                   (t.ly + t.hy) / 2::DOUBLE - c.py AS dy,
                   (t.lz + t.hz) / 2::DOUBLE - c.pz AS dz
            FROM tiles t CROSS JOIN camera c
            LEFT JOIN mask m
              ON m.tile_index = t.tile_index AND m.camera_uid = c.camera_uid))""",
    "scored": """
        scored AS (
          SELECT *, vis_factor * dist_factor AS base_score
          FROM (
            SELECT *, CASE WHEN visible THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END
                        AS vis_factor,
                   1.0::DOUBLE / (distance + 0.001::DOUBLE) AS dist_factor
            FROM measured))""",
    "levels": """
        levels AS (
          SELECT range AS lod_level, pow(10::DOUBLE, 2 - range) AS layer_weight
          FROM range(3))""",
    "utilities": """
        utilities AS (
          SELECT s.*, lod_level, base_score * layer_weight AS utility
          FROM scored s CROSS JOIN levels)""",
    "ranking": """
        ranking AS (
          SELECT *, row_number() OVER (
                      PARTITION BY camera_uid
                      ORDER BY utility DESC, tile_index, lod_level) AS rank
          FROM utilities)""",
}

# The 32-bit forms of the same steps.
_FLOAT_CTES = {
    "pairs": """
        corners AS (
          SELECT tile_index, tile_idx, lx::FLOAT AS lx, ly::FLOAT AS ly, lz::FLOAT AS lz,
                 hx::FLOAT AS hx, hy::FLOAT AS hy, hz::FLOAT AS hz
          FROM tiles),
        centers AS (
          SELECT tile_index, tile_idx, ((lx + hx)::DOUBLE / 2::DOUBLE)::FLOAT AS cx,
                 ((ly + hy)::DOUBLE / 2::DOUBLE)::FLOAT AS cy,
                 ((lz + hz)::DOUBLE / 2::DOUBLE)::FLOAT AS cz
          FROM corners),
        pairs AS (
          SELECT m.camera_uid, m.tile_index, t.tile_idx, m.visible,
                 (cx - px::FLOAT)::FLOAT AS dx, (cy - py::FLOAT)::FLOAT AS dy,
                 (cz - pz::FLOAT)::FLOAT AS dz
          FROM mask m JOIN centers t USING (tile_index) JOIN cameras c USING (camera_uid))""",
    "measured": """
        measured AS (
          SELECT camera_uid, tile_index, tile_idx, visible,
                 sqrt((((dx * dx)::FLOAT + (dy * dy)::FLOAT)::FLOAT
                       + (dz * dz)::FLOAT)::FLOAT::DOUBLE)::FLOAT AS distance
          FROM pairs)""",
    "scored": """
        scored AS (
          SELECT *, (vis_factor * dist_factor)::FLOAT AS base_score
          FROM (
            SELECT *, CASE WHEN visible THEN 1.0::FLOAT ELSE 0.01::FLOAT END AS vis_factor,
                   (1.0::DOUBLE / (distance + 0.001::FLOAT)::FLOAT::DOUBLE)::FLOAT
                     AS dist_factor
            FROM measured))""",
    "levels": """
        levels AS (
          SELECT range AS lod_level, pow(10::DOUBLE, 2 - range)::FLOAT AS layer_weight
          FROM range(3))""",
    "utilities": """
        utilities AS (
          SELECT s.*, lod_level, (base_score * layer_weight)::FLOAT AS utility
          FROM scored s CROSS JOIN levels)""",
}

_SCENE = ["tiles", "cameras", "mask", "pairs", "measured"]
_SCORES = [*_SCENE, "scored", "levels", "utilities"]
_RANKING = [*_SCORES, "ranking"]
_RANKING_COLUMNS = (
    "camera_uid, rank, tile_index, tile_idx, lod_level, visible, distance, base_score, utility"
)


def _sql(ctes: list[str], body: str, replaced: dict[str, str] | None = None) -> str:
    parts = [(replaced or {}).get(name, _CTES[name]) for name in ctes]
    return (f"WITH {','.join(parts)}\n" if parts else "") + body


def build() -> dict[str, str]:
    full_ranking = _sql(_RANKING, f"SELECT {_RANKING_COLUMNS} FROM ranking")
    return {
        "tile_centers": _sql(["embedded"], "SELECT tile_index, cx, cy, cz FROM embedded"),
        "tile_positions": """
            SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS tile_index,
                   p_partkey AS tile_idx
            FROM part""",
        "tile_distances": _sql(
            _SCENE, "SELECT camera_uid, tile_index, distance FROM measured"
        ),
        "first_camera_distances": _sql(
            ["embedded", "embedded_first"],
            "SELECT camera_uid, tile_index, distance FROM measured",
        ),
        "pair_visibility": _sql(
            ["mask"], "SELECT camera_uid, tile_index, visible FROM mask"
        ),
        "visible_tiles": _sql(
            ["mask"], "SELECT camera_uid, tile_index FROM mask WHERE visible"
        ),
        "visible_tile_labels": _sql(
            ["tiles", "mask"],
            """SELECT camera_uid, tile_index, tile_idx
               FROM mask JOIN tiles USING (tile_index) WHERE visible""",
        ),
        "visible_tile_list": _sql(
            ["tiles", "mask"],
            """SELECT camera_uid, tile_index // 256 AS page,
                      coalesce(string_agg(tile_idx::VARCHAR, ',' ORDER BY tile_index)
                                 FILTER (WHERE visible), '') AS visible_tile_idxs
               FROM mask JOIN tiles USING (tile_index)
               GROUP BY camera_uid, tile_index // 256""",
        ),
        "score_breakdown": _sql(
            [*_SCENE, "scored"],
            """SELECT camera_uid, tile_index, vis_factor, dist_factor, base_score
               FROM scored""",
        ),
        "level_weights": _sql(
            ["levels"],
            """SELECT p_partkey AS tile_index, lod_level, layer_weight
               FROM part CROSS JOIN levels""",
        ),
        "utility_long": _sql(
            _SCORES,
            """SELECT camera_uid, tile_index, lod_level,
                      tile_index * 3 + lod_level AS flat_index, utility
               FROM utilities""",
        ),
        "flat_decode": _sql(
            ["mask", "levels"],
            """SELECT camera_uid, flat_index, flat_index // 3 AS tile_index,
                      flat_index % 3 AS lod_level
               FROM (SELECT camera_uid, tile_index * 3 + lod_level AS flat_index
                     FROM mask CROSS JOIN levels)""",
        ),
        "utility_ranking": full_ranking,
        "trajectory_ranking": full_ranking,
        "ranking_of_repeats": full_ranking,
        "ranking_split_cameras": full_ranking,
        "ranking_large_camera": full_ranking,
        "ranking_from_files": full_ranking,
        "streamed_ranking": full_ranking,
        "ranking_pairs": _sql(
            _RANKING, "SELECT camera_uid, rank, tile_index, lod_level FROM ranking"
        ),
        "utility_ranking_float32": _sql(
            _RANKING, f"SELECT {_RANKING_COLUMNS} FROM ranking", _FLOAT_CTES
        ),
        "first_camera_ranking": _sql(
            ["tiles", "cameras", "mask", "first", "scored", "levels", "utilities", "ranking"],
            f"SELECT {_RANKING_COLUMNS} FROM ranking",
        ),
        "first_camera_continuous_ranking": _sql(
            ["embedded", "embedded_first", "scored", "levels", "utilities", "ranking"],
            f"SELECT {_RANKING_COLUMNS} FROM ranking",
        ),
    }
