"""Test relations derived from the whole ``events`` table.

The texts are plain SQL that Spark and DuckDB both run, so both engines see the
same tracks, scenarios and class settings. Every event becomes one raw track row;
several events of one user in the same time slot are repeated recordings of a
frame, which exercises deduplication, and empty slots are gaps in the track.
"""

FPS = 10.0
THRESHOLD = 2.0

RAW_TRACKS = """
select concat('rec', cast(cast(floor(u / 10e0) as bigint) as varchar(20))) as recording_id,
  u % 10 as trackId, cast(frame as bigint) as frame,
  round(tx + cos(radians(deg)) * s - sin(radians(deg)) * (c * s * s + off), 6) as xCenter,
  round(sin(radians(deg)) * s + cos(radians(deg)) * (c * s * s + off), 6) as yCenter,
  round(deg + degrees(atan2(2 * c * s, 1e0)), 6) as heading,
  round(v * 10 * (cos(radians(deg)) - sin(radians(deg)) * 2 * c * s), 6) as xVelocity,
  round(v * 10 * (sin(radians(deg)) + cos(radians(deg)) * 2 * c * s), 6) as yVelocity,
  4e0 + (u % 3) * 0.5e0 as length, 1.8e0 + (u % 2) * 0.2e0 as width
from (select *, v * (frame - f0) as s
      from (select u, event_id,
              case when u % 17 = 0 then 2 * t when u % 17 = 1 then 2 * t + 1 else t end as frame,
              (u * 37) % 360 as deg,
              (case when u % 13 = 0 then 0.1e0 else 1e0 end) * (8 + u % 7) / 10e0 as v,
              20 + (u * 7) % 47 as f0, ((u % 5) - 2) * 0.01e0 as c,
              (u % 4) * 0.7e0 + (event_id % 7) * 0.01e0 as off,
              case when u % 11 = 0 then 200e0 else 0e0 end as tx
            from (select user_id as u, event_id,
                    cast(((year(ts) - 2024) * 366 + dayofyear(ts) - 1) * 3 + floor(hour(ts) / 8e0) as bigint) as t
                  from events) e) k) p
"""

SCENARIOS = """
select concat('rec', cast(cast(floor(u / 10e0) as bigint) as varchar(20))) as recording_id,
  concat(cast(u % 10 as varchar(20)), '_', cast(u % 10 + 1 as varchar(20))) as scenario_id,
  case when u % 23 = 7 then 'unlisted' when u % 31 = 9 then 'tight' when u % 6 = 0 then 'tlkeep'
       when u % 6 = 1 then 'keeptl' when u % 6 = 2 then 'keeptl_sw' when u % 6 = 3 then 'cutinl'
       when u % 6 = 4 then 'cutinr' else 'uturn' end as class,
  u % 10 as ego, u % 10 + 1 as target,
  cast(case when u % 29 = 0 then 1000000 else 0 end as bigint) as min_frame,
  cast(case when u % 29 = 0 then 1000060 else 100000 end as bigint) as max_frame,
  cast(case when u % 19 = 0 then 30 end as bigint) as anchor_frame,
  concat('base_', cast(u % 6 as varchar(20)), '.xosc') as base_xosc,
  cast(u as bigint) as input_ordinal
from (select distinct user_id as u from events) e
where u % 10 < 9 and u + 1 in (select user_id from events)
"""

# Class settings: (class, anchor method, radius L, weight of the middle control point)
DEFAULT = {"anchor": "pet", "L": 10.0}
CLASSES = {
    "tlkeep": {"anchor": "pet", "L": 10.0},
    "keeptl": {"anchor": "pet", "L": 10.0},
    "keeptl_sw": {"anchor": "pet", "L": 10.0},
    "cutinl": {"anchor": "cross", "L": 5.0},
    "cutinr": {"L": 10.0},
    "uturn": {"anchor": "min_dist", "L": 8.0, "middle_cp_weight": 8.0},
    "tight": {"anchor": "cross", "L": 0.5},
}
CONFIG = {"fps": FPS, "conflict_threshold": THRESHOLD, "default": DEFAULT, "classes": CLASSES}

CLASS_ROWS = """
select * from (values
  ('tlkeep', 'pet', 10e0, cast(null as double)), ('keeptl', 'pet', 10e0, null),
  ('keeptl_sw', 'pet', 10e0, null), ('cutinl', 'cross', 5e0, null), ('cutinr', null, 10e0, null),
  ('uturn', 'min_dist', 8e0, 8e0), ('tight', 'cross', 0.5e0, null)) v(class, anchor, L, middle_cp_weight)
"""
