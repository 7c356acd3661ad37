"""SQL twins of the registered queries for DuckDB.

They are written from the definitions, not from the Spark plans: the scan walks every ray cell
by cell and joins on voxels, boxes meet all points of their scan, history is one window.
"""

from __future__ import annotations

from scanmill.config import MODELS, SensorModel

ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- inputs

FRAMES = """frames0 as (
  select frame_no, seq, 'segment-' || lpad(cast(seq as varchar), 4, '0') as sequence, n as frame_index,
    1704067200000000 + cast(seq as bigint) * 60000000 + n * 100000 + (cust % 7) * 1000 as timestamp_micros,
    cos(yaw) * cos(pit) m00, -sin(yaw) m01, cos(yaw) * sin(pit) m02, 100.0::double * seq + 1.5::double * n m03,
    sin(yaw) * cos(pit) m10, cos(yaw) m11, sin(yaw) * sin(pit) m12, -20.0::double * seq + 0.2::double * n m13,
    -sin(pit) m20, 0.0::double m21, cos(pit) m22, 0.01::double * (cust % 5) m23
  from (
    select *, 0.05::double * n + 0.001::double * (cust % 10) yaw, 0.01::double * (cust % 3) pit
    from (
      select frame_no, cust, cast(floor(frame_no / 10.0) as int) seq, frame_no - 10 * cast(floor(frame_no / 10.0) as int) n
      from (select cast(floor(o_orderkey / 75.0) as int) frame_no, arg_min(o_custkey, o_orderkey) cust from orders group by 1)
    )
  )
)"""

POINTS = """points0 as (
  select 'segment-' || lpad(cast(cast(floor(frame_no / 10.0) as int) as varchar), 4, '0') as sequence,
    frame_no - 10 * cast(floor(frame_no / 10.0) as int) as frame_index, frame_no,
    row_number() over (partition by frame_no order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) as point_ord,
    round(3.61::double + r * cos(el) * cos(az), 6) x, round(-0.154::double + r * cos(el) * sin(az), 6) y,
    round(0.338::double + r * sin(el) + l_discount * 0.5::double, 6) z, cast(l_tax as float) intensity
  from (
    select *, 5.0::double + l_quantity + case when frame_no % 11 = 5 then 150.0::double else 0.0::double end r,
      radians(-72.5::double + 0.25::double * (l_partkey % 581)) az,
      radians(case l_linenumber % 3 when 0 then -0.4::double when 1 then 0.4::double else 1.2::double end) el
    from (select *, cast(floor(l_orderkey / 75.0) as int) frame_no from lineitem)
  )
)"""

BOXES = """boxes0 as (
  select 'segment-' || lpad(cast(cast(floor(p_partkey / 100.0) as int) as varchar), 4, '0') as sequence,
    cast(floor(p_partkey / 10.0) as int) - 10 * cast(floor(p_partkey / 100.0) as int) as frame_index,
    p_partkey % 10 as box_ord,
    round(3.61::double + (4 + p_size * 0.4::double) * cos(radians(cast(p_partkey * 37 % 360 - 180 as double))), 6) cx,
    round(-0.154::double + (4 + p_size * 0.4::double) * sin(radians(cast(p_partkey * 37 % 360 - 180 as double))), 6) cy,
    0.8::double cz, 4.0::double + p_size % 5 as length, 2.0::double + (p_partkey % 3) * 0.5::double as width, 2.0::double as height,
    round((p_partkey % 63) * 0.1::double - 3.1::double, 6) heading,
    p_partkey % 5 as type, 'trk' || cast(p_partkey % 10 as varchar) as track_id,
    0.1::double * (p_partkey % 7) speed_x, 0.1::double * (p_partkey % 5) speed_y, 0.1::double * (p_partkey % 3) speed_z,
    0.1::double * (p_partkey % 4) accel_x, 0.1::double * (p_partkey % 6) accel_y, 0.1::double * (p_partkey % 2) accel_z,
    p_partkey % 97 num_points, p_partkey % 3 difficulty, p_partkey % 4 tracking_difficulty
  from part
)"""

# Sensor names, padding (below), the disc of a stamp and the signs of box corners.
SENSOR_LIST = "['front_left', 'front_center', 'front_right', 'rear_left', 'rear_center', 'rear_right']"

LABEL_TEXT = f"""label_text as (
  select case when seq % 5 < 4 then 'train' else 'val' end as split, sensor,
    'segment-' || lpad(cast(seq as varchar), 4, '0') || '_' || sensor || '_' || lpad(cast(cast(floor(p_partkey / 10.0) as int) % 10 as varchar), 3, '0') as stem,
    p_partkey % 10 as line_no,
    cast(p_size as double) x, cast(p_partkey % 21 - 10 as double) y, 4.5::double as length, 1.9::double as width,
    cast(p_partkey % 3 - 1 as double) heading,
    case p_partkey % 5 when 1 then 0 when 2 then 1 when 4 then 2 end class_id
  from (select *, cast(floor(p_partkey / 100.0) as int) seq, {SENSOR_LIST}[cast(floor(p_partkey / 100.0) as int) % 6 + 1] sensor from part)
  where p_partkey % 13 <> 0 and p_partkey % 5 in (1, 2, 4)
)"""

RASTERS = f"""rasters0 as (
  select case when seq % 5 < 4 then 'train' else 'val' end as split, {SENSOR_LIST}[seq % 6 + 1] sensor,
    sequence || '_' || {SENSOR_LIST}[seq % 6 + 1] || '_' || lpad(cast(frame_index as varchar), 3, '0') as stem
  from frames0 where frame_no % 7 <> 3
)"""

# ---------------------------------------------------------------- sensors, rays, scan

PADDING = 3.7


def mounts(model: SensorModel) -> str:
    rows = ", ".join(
        f"({i}, '{m.name}', {m.x!r}::double, {m.y!r}::double, {m.z!r}::double, {m.yaw_deg!r}::double)"
        for i, m in enumerate(model.mounts)
    )
    return f"""mounts as (
  select *, radians(yaw_deg) yaw, {PADDING}::double - sx tx, sy ty, sz tz from (values {rows}) v(mount, sensor, sx, sy, sz, yaw_deg)
)"""


def rays(model: SensorModel, name: str = "rays", precision: str = "double") -> str:
    elevations = ", ".join(
        f"({i}, {e!r}::double)" for i, e in enumerate(model.elevations_deg)
    )
    if model.azimuth_bands:
        bands = " union all ".join(
            f"select {i} band, {first!r}::double + {step!r}::double * i az from range({round((last - first) / step) + 1}) t(i)"
            for i, (first, last, step) in enumerate(model.azimuth_bands)
        )
        azimuths = f"select row_number() over (order by band, az) - 1 as col, az from ({bands})"
    else:
        step = (model.fov_max - model.fov_min) / model.azimuth_steps
        azimuths = f"select i col, {model.fov_min!r}::double + {step!r}::double * i az from range({model.azimuth_steps + 1}) t(i)"
    cell = {
        "double": lambda v: f"cast(floor({v} / 0.1::double) as int)",
        "float": lambda v: f"cast(floor(cast({v} as float) / 0.1::float) as int)",
    }[precision]
    return f"""{name}_ends as (
  select sensor, row_no * {model.azimuth_count} + col as ray_id, sx, sy, sz,
    round(sx + {model.distance!r}::double * cos(radians(el)) * cos(radians(az + yaw_deg)), 6) ex,
    round(sy + {model.distance!r}::double * cos(radians(el)) * sin(radians(az + yaw_deg)), 6) ey,
    round(sz + {model.distance!r}::double * sin(radians(el)), 6) ez
  from mounts, (values {elevations}) e(row_no, el), ({azimuths}) a
), {name} as (
  select *, greatest(abs(dx), abs(dy), abs(dz)) as len from (
    select *, cast(floor(sx / 0.1::double) as int) v0x, cast(floor(sy / 0.1::double) as int) v0y, cast(floor(sz / 0.1::double) as int) v0z,
      {cell('ex')} - cast(floor(sx / 0.1::double) as int) dx,
      {cell('ey')} - cast(floor(sy / 0.1::double) as int) dy,
      {cell('ez')} - cast(floor(sz / 0.1::double) as int) dz
    from {name}_ends
  )
)"""


def _walk(axis: str) -> str:
    return f"v0{axis} + cast(sign(d{axis}) as int) * ((2 * abs(d{axis}) * step + len) // (2 * len))"


def near_points(model: SensorModel) -> str:
    def pick(field: str) -> str:
        values = ", ".join(f"{float(getattr(m, field))!r}::double" for m in model.mounts)
        return f"[{values}][point_ord % {len(model.mounts)} + 1]"

    return f"""far0 as (select * from points0), near0 as (
  select * replace (round({pick('x')} + r * cos(az), 6) as x, round({pick('y')} + r * sin(az), 6) as y, round({pick('z')} + r * 0.01::double * (point_ord % 7 - 3), 6) as z)
  from (select *, 0.15::double + 0.01::double * (point_ord * 37 % 486) r, radians({pick('yaw_deg')} - 70 + 0.25::double * (point_ord * 11 % 561)) az from far0)
)"""


def hits(model: SensorModel, precision: str = "double") -> str:
    cell = {
        "double": lambda v: f"cast(floor({v} / 0.1::double) as int)",
        "float": lambda v: f"cast(floor(cast({v} as float) / 0.1::float) as int)",
    }[precision]
    return f"""{POINTS}, {mounts(model)}, {rays(model, precision=precision)}, cells as (
  select sensor, ray_id, step, {_walk('x')} vx, {_walk('y')} vy, {_walk('z')} vz
  from (select *, unnest(range(1, len + 1)) as step from rays)
), candidates as (
  select p.sequence, p.frame_index, p.point_ord, p.x, p.y, p.z, p.intensity, c.sensor, c.ray_id, c.step,
    r.sx, r.sy, r.sz, r.ex, r.ey, r.ez, r.ex - r.sx ux, r.ey - r.sy uy, r.ez - r.sz uz
  from cells c
  join (select *, {cell('x')} vx, {cell('y')} vy, {cell('z')} vz from points0) p on p.vx = c.vx and p.vy = c.vy and p.vz = c.vz
  join rays r on r.sensor = c.sensor and r.ray_id = c.ray_id
), measured as (
  select *, sqrt(power(x - (sx + t * ux), 2) + power(y - (sy + t * uy), 2) + power(z - (sz + t * uz), 2)) perp
  from (select *, round(((x - sx) * ux + (y - sy) * uy + (z - sz) * uz) / (ux * ux + uy * uy + uz * uz), 12) t from candidates)
  where t >= 0
), hits as (
  select * from measured
  qualify row_number() over (partition by sequence, frame_index, sensor, ray_id order by step, round(perp, 9), t, point_ord) = 1
)"""


def scan(model: SensorModel, precision: str = "double") -> str:
    moved = [
        f"cast(s{a} + sqrt((x-sx)*(x-sx) + (y-sy)*(y-sy) + (z-sz)*(z-sz)) * u{a} / sqrt(ux*ux + uy*uy + uz*uz) as float)"
        for a in "xyz"
    ]
    return f"""{hits(model, precision)}, scan as (
  select sequence, frame_index, sensor, ray_id, qx as x, qy as y, qz as z, intensity from (
    select sequence, frame_index, sensor, ray_id, {moved[0]} qx, {moved[1]} qy, {moved[2]} qz, intensity from hits
  ) qualify row_number() over (partition by sequence, frame_index, sensor, qx, qy, qz order by ray_id) = 1
)"""


SCAN = scan(MODELS["scala"])


def r6(expr: str, name: str | None = None) -> str:
    return f"round(cast({expr} as double), 6) + 0.0 as {name or expr}"


def reals(*names: str) -> str:
    return ", ".join(r6(n) for n in names)


def big(*names: str) -> str:
    return ", ".join(f"cast({n} as bigint) as {n}" for n in names)


def wrap(angle: str) -> str:
    return f"(({angle}) - 2 * pi() * floor((({angle}) + pi()) / (2 * pi())))"


def to_sensor(x: str, y: str, z: str) -> tuple[str, str, str]:
    return (
        f"(cos(yaw) * (({x}) - tx) + sin(yaw) * (({y}) - ty))",
        f"(-sin(yaw) * (({x}) - tx) + cos(yaw) * (({y}) - ty))",
        f"(({z}) - tz)",
    )


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---------------------------------------------------------------- splits, frames, walks

oracle("split_sample", f"""with {FRAMES}, listed as (
  select distinct case when seq % 5 < 4 then 'train' else 'val' end split, sequence from frames0
  union all values ('train', 'segment-missing-1'), ('val', 'segment-missing-2')
), drawn as (
  select *, row_number() over (partition by split order by md5('0:' || sequence)) rn, count(*) over (partition by split) n from listed
)
select split, sequence from drawn where rn <= floor(n * 60.0::double / 100.0::double)
  and sequence in (select sequence from frames0)""")

oracle("sensor_discovery", f"""select sensor, count(*) as n_rows, cast(sensor in (select unnest({SENSOR_LIST})) as bigint) as valid
from (select ['front_left', 'front_center', 'front_right', 'rear_left', 'rear_center', 'rear_right', 'side_left', 'roof'][p_partkey % 8 + 1] sensor from part)
group by sensor""")

oracle("frame_ordinals", f"""with {FRAMES}
select sequence, cast(timestamp_micros as bigint) as timestamp_micros,
  row_number() over (partition by sequence order by timestamp_micros) - 1 as frame_index from frames0""")

oracle("frame_ordinals_ties", f"""with {FRAMES}, stamped as (select sequence, frame_no, cast(timestamp_micros as bigint) // 400000 * 400000 as timestamp_micros from frames0)
select sequence, timestamp_micros, cast(frame_no as bigint) as frame_no,
  row_number() over (partition by sequence order by timestamp_micros, frame_no) - 1 as frame_index from stamped""")

oracle("split_points", f"""with {FRAMES}, {POINTS}, listed as (
  select distinct case when seq % 5 < 4 then 'train' else 'val' end split, sequence from frames0
  union all values ('train', 'segment-missing-1'), ('val', 'segment-missing-2')
), drawn as (
  select *, row_number() over (partition by split order by md5('0:' || sequence)) rn, count(*) over (partition by split) n from listed
)
select case split when 'train' then 'training' else 'validation' end as split, p.sequence, cast(p.frame_index as bigint) as frame_index, point_ord, {reals('x', 'y', 'z')}
from points0 p join drawn d on d.sequence = p.sequence and rn <= floor(n * 60.0::double / 100.0::double)
join frames0 f on f.sequence = p.sequence and f.frame_index = p.frame_index""")

oracle("ray_walk", f"""with {POINTS}, {mounts(MODELS['scala'])}, walks as (
  select *, greatest(abs(dx), abs(dy), abs(dz)) len from (
    select sequence, frame_index, point_ord, {", ".join(f"cast(floor(s{a} / 0.1::double) as int) v0{a}" for a in "xyz")},
      {", ".join(f"cast(floor({a} / 0.1::double) as int) - cast(floor(s{a} / 0.1::double) as int) d{a}" for a in "xyz")}
    from points0, (select * from mounts where sensor = 'front_center')
  )
), cells as (
  select sequence, frame_index, point_ord, step, len, {_walk('x')} vx, {_walk('y')} vy, {_walk('z')} vz
  from (select *, unnest(range(1, len + 1)) as step from walks)
)
select sequence, cast(frame_index as bigint) frame_index, point_ord, count(*) as n_cells,
  {", ".join(f"cast(max(v{a}) filter (where step = len) as bigint) as last_{a}" for a in "xyz")},
  {", ".join(f"cast(sum(v{a} * step) as bigint) as sum_{a}" for a in "xyz")}
from cells group by all""")

# ---------------------------------------------------------------- range images

PIXELS = """pixels as (
  select 'segment-' || lpad(cast(cast(floor(frame_no / 10.0) as int) as varchar), 4, '0') as sequence,
    frame_no - 10 * cast(floor(frame_no / 10.0) as int) as frame_index, frame_no,
    vec_id % 5 + 1 as laser, vec_id % 2 as ret, idx,
    idx // 8 as img_row, idx % 8 as img_col,
    cast(cast(floor(cast(v as double) * 1000) / 10.0::double as float) as double) rng,
    cast(floor(abs(cast(v as double)) * 1000) / 1000.0::double as float) intensity,
    (idx + vec_id) % 17 = 0 nlz
  from (select vec_id, cast(floor(vec_id / 10.0) as int) frame_no, unnest(range(64)) idx, unnest(embedding) v from embeddings)
), sequences as (select distinct sequence, seq from frames0), calibrated as (
  select p.*, e.c, e.s,
    case when laser % 2 = 1 then 0.3::double - 0.05::double * img_row
      else (8 - img_row - 0.5::double) / 8 * (0.3::double + 0.1::double) - 0.1::double end inc,
    (((8 - img_col - 0.5::double) / 8) * 2.0::double - 1.0::double) * pi() - atan2(e.s, e.c) az
  from pixels p join (
    select sequence, l, cos(0.1::double * l + 0.001::double * (seq % 7)) c, sin(0.1::double * l + 0.001::double * (seq % 7)) s
    from sequences, range(1, 6) t(l)
  ) e on e.sequence = p.sequence and e.l = p.laser
  where rng > 0 and not nlz
), local as (
  select *, c * (rng * cos(inc) * cos(az)) - s * (rng * cos(inc) * sin(az)) + 0.5::double * laser as lx,
    s * (rng * cos(inc) * cos(az)) + c * (rng * cos(inc) * sin(az)) - 0.1::double as ly,
    rng * sin(inc) + 1.5::double as lz
  from calibrated
), top as (
  select l.*, cr.roll, cr.pitch, cr.yaw, cr.px, cr.py, cr.pz, f.m00, f.m01, f.m02, f.m03, f.m10, f.m11, f.m12, f.m13, f.m20, f.m21, f.m22, f.m23
  from (select *, row_number() over () rid from local where laser = 1) l
  join lateral (select cast(cast(0.001::double * (l.idx % 7) as float) as double) roll, cast(cast(0.002::double * (l.idx % 5) as float) as double) pitch,
    cast(cast(0.01::double * (l.frame_no % 10) + 0.001::double * (l.idx % 3) as float) as double) yaw,
    cast(cast(10.0::double * l.frame_no + 0.01::double * l.idx as float) as double) px,
    cast(cast(0.02::double * l.idx - 1.0::double as float) as double) py, cast(cast(0.1::double * (l.idx % 4) as float) as double) pz) cr on true
  join frames0 f on f.sequence = l.sequence and f.frame_index = l.frame_index
), world as (
  select *,
    cos(yaw)*cos(pitch)*lx + (cos(yaw)*sin(pitch)*sin(roll) - sin(yaw)*cos(roll))*ly + (cos(yaw)*sin(pitch)*cos(roll) + sin(yaw)*sin(roll))*lz + px - m03 as wx,
    sin(yaw)*cos(pitch)*lx + (sin(yaw)*sin(pitch)*sin(roll) + cos(yaw)*cos(roll))*ly + (sin(yaw)*sin(pitch)*cos(roll) - cos(yaw)*sin(roll))*lz + py - m13 as wy,
    -sin(pitch)*lx + cos(pitch)*sin(roll)*ly + cos(pitch)*cos(roll)*lz + pz - m23 as wz
  from top
), top_points as (
  select sequence, frame_index, laser, ret, idx, cast(m00*wx + m10*wy + m20*wz as float) x, cast(m01*wx + m11*wy + m21*wz as float) y,
    cast(m02*wx + m12*wy + m22*wz as float) z, intensity from world
)"""

oracle("range_to_points", f"""with {FRAMES}, {PIXELS}
select sequence, {big('frame_index', 'laser', 'ret', 'idx')}, {r6('cast(lx as float)', 'x')}, {r6('cast(ly as float)', 'y')},
  {r6('cast(lz as float)', 'z')}, {r6('intensity')} from local""")

oracle("range_to_points_top", f"""with {FRAMES}, {PIXELS}
select sequence, {big('frame_index', 'laser', 'ret', 'idx')}, {reals('x', 'y', 'z', 'intensity')} from top_points""")

oracle("dense_cloud", f"""with {FRAMES}, {PIXELS}, both_kinds as (
  select sequence, frame_index, laser, ret, idx, cast(lx as float) x, cast(ly as float) y, cast(lz as float) z, intensity from local where laser <> 1
  union all select * from top_points
)
select sequence, {big('frame_index')}, cast((ret * 64 + laser) * 4294967296 + idx as bigint) as point_ord, {reals('x', 'y', 'z', 'intensity')} from both_kinds""")

# ---------------------------------------------------------------- voxels and scans

VOXELS = "select *, cast(floor(x / 0.1::double) as int) vx, cast(floor(y / 0.1::double) as int) vy, cast(floor(z / 0.1::double) as int) vz from points0"

oracle("voxel_centroid", f"""with {POINTS}
select sequence, {big('frame_index', 'vx', 'vy', 'vz')}, {r6('avg(x)', 'x')}, {r6('avg(y)', 'y')}, {r6('avg(z)', 'z')}, count(*) as n
from ({VOXELS}) group by sequence, frame_index, vx, vy, vz""")

oracle("voxel_nearest", f"""with {POINTS}
select sequence, {big('frame_index', 'vx', 'vy', 'vz', 'point_ord')}, {reals('x', 'y', 'z')} from ({VOXELS})
qualify row_number() over (partition by sequence, frame_index, vx, vy, vz order by round(sqrt(
  power(x - (vx + 0.5::double) * 0.1::double, 2) + power(y - (vy + 0.5::double) * 0.1::double, 2) + power(z - (vz + 0.5::double) * 0.1::double, 2)), 9), point_ord) = 1""")

for _name, _model in (("first_hits", "scala"), ("first_hits_banded", "scala2")):
    oracle(_name, f"""with {hits(MODELS[_model])}
select sequence, sensor, {big('frame_index', 'ray_id', 'step', 'point_ord')} from hits""")

for _name, _model in (("first_hits_near", "scala"), ("first_hits_near_banded", "scala2")):
    _near = hits(MODELS[_model]).replace(POINTS, f"{POINTS}, {near_points(MODELS['scala'])}", 1).replace("from points0) p on", "from near0) p on")
    oracle(_name, f"""with {_near}
select sequence, sensor, {big('frame_index', 'ray_id', 'step', 'point_ord')} from hits""")

for _name, _precision in (("sparse_scan", "double"), ("sparse_scan_single", "float")):
    oracle(_name, f"""with {scan(MODELS['scala'], _precision)}
select sequence, sensor, {big('frame_index', 'ray_id')}, {reals('x', 'y', 'z', 'intensity')} from scan""")

_XS, _YS, _ZS = to_sensor("cast(x as double)", "cast(y as double)", "cast(z as double)")
LOCAL = f"""local_scan as (
  select sequence, frame_index, s.sensor, ray_id, cast({_XS} as float) x, cast({_YS} as float) y, cast({_ZS} as float) z, intensity
  from scan s join mounts m on m.sensor = s.sensor
)"""

oracle("points_1f", f"""with {SCAN}, {LOCAL}
select sequence, sensor, {big('frame_index', 'ray_id')}, {reals('x', 'y', 'z', 'intensity')} from local_scan""")

# ---------------------------------------------------------------- boxes and labels

SEEN = f"""seen as (
  select *, case type when 1 then 0.0::double when 2 then 0.0::double else 0.0::double end as red,
    case type when 1 then 1.0::double when 2 then 0.0::double else 0.5::double end as green,
    case type when 1 then 0.0::double when 2 then 1.0::double else 0.5::double end as blue
  from (select b.*, m.sensor, degrees(atan2(cy - sy, cx - sx)) - yaw_deg + 180.0::double as turn from boxes0 b, mounts m where type in (1, 2, 4))
  where abs(turn - 360.0::double * floor(turn / 360.0::double) - 180.0::double) <= 72.5::double
)"""


def kept(rotation: str) -> str:
    x, y, z = "(p.x - b.cx)", "(p.y - b.cy)", "(p.z - b.cz)"
    c, s = "cos(b.heading)", "sin(b.heading)"
    local = {
        "inverse_yaw": (f"{c}*{x} + {s}*{y}", f"-{s}*{x} + {c}*{y}", z),
        "forward_yaw": (f"{c}*{x} - {s}*{y}", f"{s}*{x} + {c}*{y}", z),
        "pinned": (x, f"{c}*{y} - {s}*{z}", f"{s}*{y} + {c}*{z}"),
    }[rotation]
    inside = " and ".join(f"abs({v}) <= b.{d} / 2" for v, d in zip(local, ("length", "width", "height")))
    return f"""{BOXES}, {SEEN}, counted as (
  select b.sequence, b.frame_index, b.sensor, b.box_ord, count(*) as num_points_scan
  from seen b join (select sequence, frame_index, sensor, cast(x as double) x, cast(y as double) y, cast(z as double) z from scan) p
    on p.sequence = b.sequence and p.frame_index = b.frame_index and p.sensor = b.sensor and {inside}
  group by all having count(*) >= 4
), kept as (
  select b.*, c.num_points_scan from seen b join counted c using (sequence, frame_index, sensor, box_ord)
)"""


oracle("boxes_in_fov", f"""with {BOXES}, {mounts(MODELS['scala'])}, {SEEN}
select sequence, sensor, track_id, {big('frame_index', 'box_ord', 'type', 'num_points', 'difficulty', 'tracking_difficulty')},
  {reals('cx', 'cy', 'cz', 'length', 'width', 'height', 'heading', 'speed_x', 'speed_y', 'speed_z', 'accel_x', 'accel_y', 'accel_z', 'red', 'green', 'blue')}
from seen""")

for _rotation in ("inverse_yaw", "forward_yaw", "pinned"):
    oracle(f"box_counts_{_rotation.split('_')[0]}", f"""with {SCAN}, {kept(_rotation)}
select sequence, sensor, {big('frame_index', 'box_ord', 'type', 'num_points', 'num_points_scan')} from kept""")

oracle("box_counts_far", f"""with {POINTS}, {BOXES}, {mounts(MODELS['scala'])}, far as (
  select sequence, frame_index, box_ord, type, cx + 400 as cx, cy, cz, heading, k * length as length, k * width as width, k * height as height
  from (select *, case when box_ord % 7 = 0 then 30.0::double else 1.0::double end k from boxes0)
), seen as (
  select * from (select b.*, m.sensor, degrees(atan2(cy - sy, cx - sx)) - yaw_deg + 180.0::double as turn from far b, mounts m where type in (1, 2, 4))
  where sensor = 'front_center' and abs(turn - 360.0::double * floor(turn / 360.0::double) - 180.0::double) <= 72.5::double
)
select b.sequence, cast(b.frame_index as bigint) as frame_index, b.sensor, cast(b.box_ord as bigint) as box_ord, count(*) as n
from seen b join points0 p on p.sequence = b.sequence and p.frame_index = b.frame_index
  and abs(cos(heading) * (x + 400 - cx) + sin(heading) * (y - cy)) <= length / 2
  and abs(-sin(heading) * (x + 400 - cx) + cos(heading) * (y - cy)) <= width / 2 and abs(z - cz) <= height / 2
group by all""")

oracle("sparse_scan_repeats", f"""with {SCAN}, coarse as (
  select sequence, frame_index, sensor, ray_id, {", ".join(f"cast(floor(cast({a} as double)) as float) as {a}" for a in "xyz")}, intensity from scan
)
select sequence, sensor, {big('frame_index', 'ray_id')}, {reals('x', 'y', 'z', 'intensity')} from coarse
qualify row_number() over (partition by sequence, frame_index, sensor, x, y, z order by ray_id) = 1""")

_BX, _BY, _BZ = to_sensor("cx", "cy", "cz")
LABELS = f"""{kept('inverse_yaw')}, labels0 as (
  select k.sequence, k.frame_index, k.sensor, box_ord, case type when 1 then 'Vehicle' when 2 then 'Pedestrian' else 'Cyclist' end as name,
    track_id, cx, cy, cz, length, width, height, heading, {_BX} xs, {_BY} ys, {_BZ} zs, {wrap('heading - yaw')} heading_s
  from kept k join mounts m on m.sensor = k.sensor
), scans as (select distinct sequence, frame_index, sensor from scan)"""

oracle("label_boxes", f"""with {SCAN}, {LABELS}
select sequence, sensor, name, track_id, {big('frame_index', 'box_ord')},
  {reals('cx', 'cy', 'cz', 'length', 'width', 'height', 'heading', 'xs', 'ys', 'zs', 'heading_s')} from labels0""")

_NUMBERS = ", ".join(f"round({c}, 6) + 0.0::double" for c in ("xs", "ys", "zs", "length", "width", "height", "heading_s"))
oracle("label_lines", f"""with {SCAN}, {LABELS}
select s.sequence, s.sensor, cast(s.frame_index as bigint) as frame_index,
  s.sequence || '_' || s.sensor || '_' || lpad(cast(s.frame_index as varchar), 3, '0') as stem,
  cast(box_ord as bigint) as line_no,
  case when box_ord is not null then printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %s', {_NUMBERS}, name) end as line
from scans s left join labels0 l on l.sequence = s.sequence and l.frame_index = s.frame_index and l.sensor = s.sensor""")

# ---------------------------------------------------------------- history, motion, fusion, tracks

PAIRS = """scan_keys as (select distinct sequence, frame_index, sensor from scan), ranked as (
  select *, row_number() over (partition by sequence, sensor order by frame_index) rn from scan_keys
), pairs as (
  select c.sequence, c.sensor, c.frame_index, s.frame_index as source_frame, c.rn - s.rn as k
  from ranked c join ranked s on s.sequence = c.sequence and s.sensor = c.sensor and c.rn - s.rn between 0 and 3
)"""


def _relative() -> str:
    shift = ["(s.m03 - c.m03)", "(s.m13 - c.m13)", "(s.m23 - c.m23)"]
    out = []
    for i in range(3):
        for j in range(3):
            value = " + ".join(f"c.m{a}{i} * s.m{a}{j}" for a in range(3))
            out.append(f"case when k = 0 then {1.0 if i == j else 0.0}::double else {value} end r{i}{j}")
        value = " + ".join(f"c.m{a}{i} * {shift[a]}" for a in range(3))
        out.append(f"case when k = 0 then 0.0::double else {value} end t{i}")
    return ", ".join(out)


MOVES = f"""{FRAMES}, {PAIRS}, moves as (
  select p.*, c.timestamp_micros ts, s.timestamp_micros source_ts, {_relative()},
    c.m03 cur_x, c.m13 cur_y, atan2(c.m10, c.m00) cur_yaw, s.m03 src_x, s.m13 src_y, atan2(s.m10, s.m00) src_yaw
  from pairs p join frames0 c on c.sequence = p.sequence and c.frame_index = p.frame_index
  join frames0 s on s.sequence = p.sequence and s.frame_index = p.source_frame
)"""

oracle("history_pairs", f"""with {SCAN}, {PAIRS}
select sequence, sensor, {big('frame_index', 'source_frame', 'k')} from pairs""")

oracle("ego_motion", f"""with {SCAN}, {MOVES}
select sequence, sensor, {big('frame_index', 'k')}, {reals(*[f'r{i}{j}' for i in range(3) for j in range(3)], 't0', 't1', 't2')} from moves""")

_BACK = [[" + ".join(f"c.m{i}{a} * s.m{j}{a}" for a in range(3)) for j in range(3)] for i in range(3)]
_BACK_SHIFT = [f"c.m{i}3 - (" + " + ".join(f"({_BACK[i][j]}) * s.m{j}3" for j in range(3)) + ")" for i in range(3)]
_BACK_FIELDS = ", ".join(
    f"case when k = 0 then {1.0 if i == j else 0.0}::double else {_BACK[i][j]} end r{i}{j}" for i in range(3) for j in range(3)
) + ", " + ", ".join(f"case when k = 0 then 0.0::double else {v} end t{i}" for i, v in enumerate(_BACK_SHIFT))
oracle("ego_motion_inverse", f"""with {SCAN}, {FRAMES}, {PAIRS}, moves as (
  select p.*, {_BACK_FIELDS} from pairs p join frames0 c on c.sequence = p.sequence and c.frame_index = p.frame_index
  join frames0 s on s.sequence = p.sequence and s.frame_index = p.source_frame
)
select sequence, sensor, {big('frame_index', 'k')}, {reals(*[f'r{i}{j}' for i in range(3) for j in range(3)], 't0', 't1', 't2')} from moves""")

_PX = [f"(r{i}0 * cast(x as double) + r{i}1 * cast(y as double) + r{i}2 * cast(z as double) + t{i})" for i in range(3)]
_FX, _FY, _FZ = to_sensor(*_PX)
for _n in (2, 4):
    oracle(f"points_{_n}f", f"""with {SCAN}, {MOVES}, fused as (
  select v.sequence, v.frame_index, v.sensor, k, ray_id, cast({_FX} as float) x, cast({_FY} as float) y, cast({_FZ} as float) z, intensity,
    greatest(-1.0::float, least(0.0::float, cast((source_ts - ts) / {float(_n - 1) * 1e5!r}::double as float))) dt_norm
  from moves v join scan p on p.sequence = v.sequence and p.sensor = v.sensor and p.frame_index = v.source_frame
  join mounts m on m.sensor = v.sensor where k < {_n}
)
select sequence, sensor, {big('frame_index', 'k', 'ray_id')}, {reals('x', 'y', 'z', 'intensity', 'dt_norm')} from fused""")

oracle("points_horizon", ORACLES["points_4f"].replace("greatest(-1.0::float, least(0.0::float, cast((source_ts - ts) / 300000.0::double as float)))", "cast((source_ts - ts) / 250000.0::double as float)"))

_CX = [f"(r{i}0 * cx + r{i}1 * cy + r{i}2 * cz + t{i})" for i in range(3)]
_TX, _TY, _TZ = to_sensor(*_CX)
for _n in (2, 4):
    oracle(f"tracks_{_n}f", f"""with {SCAN}, {LABELS}, {MOVES}, tracked as (
  select v.sequence, v.sensor, v.frame_index, k, l.box_ord, l.name, l.track_id, {_TX} x, {_TY} y, {_TZ} z,
    l.length, l.width, l.height, {wrap('heading + atan2(r10, r00) - yaw')} heading,
    count(distinct k) over (partition by v.sequence, v.sensor, v.frame_index) num_frames,
    row_number() over (partition by v.sequence, v.sensor, v.frame_index, k order by l.box_ord) - 1 as rn
  from moves v join mounts m on m.sensor = v.sensor
  left join labels0 l on l.sequence = v.sequence and l.sensor = v.sensor and l.frame_index = v.source_frame
  where k < {_n}
)
select sequence as sequence_name, sensor, name, track_id, {big('frame_index', 'num_frames')}, cast(k as bigint) as frame_id,
  cast(case when box_ord is not null then rn end as bigint) as pos, {reals('x', 'y', 'z', 'length', 'width', 'height', 'heading')} from tracked""")

oracle("tracks_wrapped", f"""with {SCAN}, {LABELS}, {MOVES}, moved as (
  select v.sequence, v.sensor, v.frame_index, k, box_ord, name, track_id, cast({_CX[0]} as float) x, cast({_CX[1]} as float) y, cast({_CX[2]} as float) z,
    length, width, height, cast({wrap('heading + atan2(r10, r00)')} as float) as heading
  from moves v join labels0 l on l.sequence = v.sequence and l.sensor = v.sensor and l.frame_index = v.source_frame
)
select sequence, sensor, name, track_id, {big('frame_index', 'k', 'box_ord')}, {reals('x', 'y', 'z', 'length', 'width', 'height', 'heading')} from moved""")

# ---------------------------------------------------------------- rasters

STAMP = "(values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(ox, oy)"
SHARE = "greatest(0.0::double, least(1.0::double, (z + 1.0::double) / 3.0::double))"


def _paint(source: str, middle: float = 0.0) -> str:
    return f"""stamped as (
  select *, cast(trunc(round({middle!r}::double + x / 0.1::double, 6)) as int) + ox px, cast(trunc(round(512.0::double - y / 0.1::double, 6)) as int) + oy py,
    cast(trunc(round({SHARE} * 255.0::double, 6)) as int) high, cast(trunc(round((1.0::double - {SHARE}) * 255.0::double, 6)) as int) low
  from {source}, {STAMP}
), painted as (select * from stamped where px between 0 and 1023 and py between 0 and 1023)"""


oracle("raster_height", f"""with {SCAN}, {LOCAL}, wide as (
  select sequence, frame_index, sensor, ray_id, cast(x as double) x, cast(y as double) y, cast(z as double) z from local_scan
), {_paint('wide')}
select sequence, sensor, {big('frame_index', 'px', 'py')}, cast(arg_max(low, ray_id) as bigint) b, cast(0 as bigint) g, cast(arg_max(high, ray_id) as bigint) r
from painted group by sequence, sensor, frame_index, px, py""")

oracle("raster_height_centre", f"""with {SCAN}, {LOCAL}, wide as (
  select sequence, frame_index, sensor, ray_id, cast(x as double) x, cast(y as double) y, cast(z as double) z from local_scan
), {_paint('wide', 512.0)}
select sequence, sensor, {big('frame_index', 'px', 'py')}, cast(arg_max(low, ray_id) as bigint) b, cast(0 as bigint) g, cast(arg_max(high, ray_id) as bigint) r
from painted group by sequence, sensor, frame_index, px, py""")

for _method, _value in (("overlap", "255"), ("overlap_height", "high")):
    oracle(f"raster_{_method}", f"""with {SCAN}, {LOCAL}, {MOVES}, swung as (
  select v.sequence, v.sensor, v.frame_index, v.source_frame, yaw, tx, ty, {wrap('src_yaw - cur_yaw')} turn,
    cos(-cur_yaw) * (src_x - cur_x) - sin(-cur_yaw) * (src_y - cur_y) vx, sin(-cur_yaw) * (src_x - cur_x) + cos(-cur_yaw) * (src_y - cur_y) vy
  from moves v join mounts m on m.sensor = v.sensor where k = 1
), shifted as (
  select *, vx + cos(turn) * tx - sin(turn) * ty - tx ax, vy + sin(turn) * tx + cos(turn) * ty - ty ay from swung
), everything as (
  select sequence, frame_index, sensor, ray_id, cast(x as double) x, cast(y as double) y, cast(z as double) z, false earlier from local_scan
  union all
  select v.sequence, v.frame_index, v.sensor, ray_id,
    cos(yaw) * ax + sin(yaw) * ay + cos(turn) * cast(x as double) - sin(turn) * cast(y as double),
    -sin(yaw) * ax + cos(yaw) * ay + sin(turn) * cast(x as double) + cos(turn) * cast(y as double), cast(z as double), true
  from shifted v join local_scan p on p.sequence = v.sequence and p.sensor = v.sensor and p.frame_index = v.source_frame
), {_paint('everything')}
select sequence, sensor, {big('frame_index', 'px', 'py')}, cast(0 as bigint) b,
  cast(coalesce(arg_max({_value}, ray_id) filter (where not earlier), 0) as bigint) g, cast(coalesce(arg_max({_value}, ray_id) filter (where earlier), 0) as bigint) r
from painted group by sequence, sensor, frame_index, px, py""")

oracle("raster_tiles", f"""with pixels0 as ({ORACLES['raster_overlap_height']}), scans0 as (
  select sequence, sensor, frame_index, count(*) as n_pixels, count(distinct py) as n_lines, list(distinct py) as painted_lines from pixels0 group by all
), bits as (
  select *, list_aggregate(list_transform(range(0, 256), lambda k: format('{{:x}}', cast(list_sum(list_transform(range(0, 4),
    lambda j: case when list_contains(painted_lines, 4 * k + j) then 1 << (3 - j) else 0 end)) as int))), 'string_agg', '') as nibbles from scans0
)
select p.*, n_pixels, n_lines, md5(unhex(nibbles)) as occupied
from pixels0 p join bits s on s.sequence = p.sequence and s.sensor = p.sensor and s.frame_index = p.frame_index""")

# ---------------------------------------------------------------- oriented boxes

CORNER_SIGNS = ((1, 1), (-1, 1), (-1, -1), (1, -1))


def _corners() -> str:
    out = []
    for i, (a, b) in enumerate(CORNER_SIGNS, start=1):
        out.append(f"x + cos(heading) * (length * {a * 0.5}::double) - sin(heading) * (width * {b * 0.5}::double) x{i}")
        out.append(f"y + sin(heading) * (length * {a * 0.5}::double) + cos(heading) * (width * {b * 0.5}::double) y{i}")
    return ", ".join(out)


CORNERS = f"{LABEL_TEXT}, corners as (select *, {_corners()} from label_text)"
NAMES = [f"{a}{i}" for i in range(1, 5) for a in "xy"]
NORMALISED = CORNERS + ", normalised as (select split, sensor, stem, line_no, class_id, " + ", ".join(
    f"x{i} / 0.1::double / 1024 as x{i}, (512.0::double - y{i} / 0.1::double) / 1024 as y{i}" for i in range(1, 5)
) + " from corners)"
TEXT = "printf('%d %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', class_id, " + ", ".join(f"round({n}, 6) + 0.0::double" for n in NAMES) + ")"
NUMBERED = f"""{FRAMES}, {RASTERS}, numbered as (
  select split, sensor, stem, n_boxes, row_number() over (partition by split order by sensor, stem) - 1 as sample_index
  from (select split, sensor, stem, count(*) n_boxes from label_text where (split, sensor, stem) in (select (split, sensor, stem) from rasters0) group by all)
)"""

oracle("parsed_labels", f"""with {LABEL_TEXT}
select split, sensor, stem, {big('line_no', 'class_id')}, {reals('x', 'y', 'length', 'width', 'heading')} from label_text""")

oracle("obb_corners", f"with {CORNERS} select stem, {big('line_no', 'class_id')}, {reals(*NAMES)} from corners")

oracle("obb_normalised", f"""with {NORMALISED}
select split, sensor, stem, {big('line_no', 'class_id')}, {reals(*NAMES)}, {TEXT} as text from normalised""")

oracle("obb_corner_order", f"""with {CORNERS}, flat as (
  {" union all ".join(f"select stem, line_no, x{i} x, y{i} y, (x1+x2+x3+x4)/4 mx, (y1+y2+y3+y4)/4 my from corners" for i in range(1, 5))}
)
select stem, {big('line_no')}, row_number() over (partition by stem, line_no order by atan2(y - my, x - mx)) - 1 as pos, {reals('x', 'y')} from flat""")

oracle("obb_samples", f"with {LABEL_TEXT}, {NUMBERED} select split, sensor, stem, n_boxes, sample_index from numbered")

oracle("obb_training_lines", f"""with {NORMALISED}, {NUMBERED}
select n.split, sample_index, cast(line_no as bigint) line_no, cast(class_id as bigint) class_id, {TEXT} as text
from normalised n join numbered u on u.split = n.split and u.sensor = n.sensor and u.stem = n.stem""")

oracle("split_manifest", f"""with {LABEL_TEXT}, {NUMBERED}
select split, '/data/obb/images/' || split || '/' || lpad(cast(sample_index as varchar), 7, '0') || '.png' as path from numbered""")

oracle("samples_per_split", f"""with {LABEL_TEXT}, {NUMBERED}
select split, count(*) as n_samples, cast(sum(n_boxes) as bigint) as n_boxes from numbered group by split""")

# ---------------------------------------------------------------- parts of rigs and of splits, written datasets

oracle("points_of_two_sensors", f"""with {SCAN}, {LOCAL}
select sequence, sensor, {big('frame_index', 'ray_id')}, {reals('x', 'y', 'z', 'intensity')} from local_scan where sensor in ('front_right', 'rear_left')""")

LISTED = """listed as (
  select distinct case when seq % 5 < 4 then 'train' else 'val' end split, seq, sequence from frames0
)"""

oracle("split_left_over", f"""with {FRAMES}, {LISTED}, drawn as (
  select *, row_number() over (partition by split order by md5('0:' || sequence)) rn, count(*) over (partition by split) n from (
    select split, sequence from listed union all values ('train', 'segment-missing-1'), ('val', 'segment-missing-2')
  )
)
select split, sequence from drawn where rn > floor(n * 60.0::double / 100.0::double) and sequence in (select sequence from frames0)""")

oracle("dataset_two_calls", f"""with {SCAN}, {LOCAL}, {FRAMES}, {LISTED}
select case split when 'train' then 'training' else 'validation' end as split, p.sequence, p.sensor, cast(p.frame_index as bigint) as frame_index,
  cast(ray_id as bigint) as ray_id, {reals('x', 'y', 'z')}, {r6("intensity + case when seq % 10 = 1 then 1 else 0 end", 'intensity')}
from local_scan p join listed l on l.sequence = p.sequence
where p.sensor = 'front_center' and (p.sequence, p.frame_index) in (select (sequence, frame_index) from frames0)""")

_LINE_FIELDS = ", ".join(f"round({c}, 6) + 0.0::double as {n}" for c, n in (("xs", "x"), ("ys", "y"), ("length", "length"), ("width", "width"), ("heading_s", "heading")))
oracle("generated_obb_lines", f"""with {SCAN}, {LOCAL}, {LABELS}, {FRAMES}, {LISTED}, wide as (
  select sequence, frame_index, sensor, ray_id, cast(x as double) x, cast(y as double) y, cast(z as double) z from local_scan
), {_paint('wide')}, stored as (
  select case split when 'train' then 'training' else 'validation' end as split, l.sensor,
    l.sequence || '_' || l.sensor || '_' || lpad(cast(l.frame_index as varchar), 3, '0') as stem, box_ord as line_no,
    case name when 'Vehicle' then 0 when 'Pedestrian' then 1 else 2 end as class_id, {_LINE_FIELDS}
  from labels0 l join listed s on s.sequence = l.sequence
  where (l.sequence, l.frame_index) in (select (sequence, frame_index) from frames0)
    and (l.sequence, l.frame_index, l.sensor) in (select (sequence, frame_index, sensor) from painted)
), corners as (select *, {_corners()} from stored), normalised as (
  select split, sensor, stem, line_no, class_id, {", ".join(f"x{i} / 0.1::double / 1024 as x{i}, (512.0::double - y{i} / 0.1::double) / 1024 as y{i}" for i in range(1, 5))}
  from corners
), numbered as (
  select split, sensor, stem, row_number() over (partition by split order by sensor, stem) - 1 as sample_index from (select distinct split, sensor, stem from stored)
)
select n.split, sample_index, cast(line_no as bigint) line_no, cast(class_id as bigint) class_id, {TEXT} as text
from normalised n join numbered u on u.split = n.split and u.sensor = n.sensor and u.stem = n.stem""")

# ---------------------------------------------------------------- planes

oracle("plane_to_sensor", f"""with {mounts(MODELS['scala'])}, raw as (
  select s_suppkey plane_id, 0.02::double * (s_suppkey % 5 - 2) a, 0.01::double * (s_suppkey % 7 - 3) b,
    case when s_suppkey % 4 = 0 then -1.0::double else 1.0::double end c, 0.1::double * (s_suppkey % 9) d from supplier
), moved as (
  select plane_id, sensor, cos(yaw) * a + sin(yaw) * b a, -sin(yaw) * a + cos(yaw) * b b, c, a * tx + b * ty + c * tz + d as d,
    sqrt(a * a + b * b + c * c) * case when c < 0 then -1 else 1 end n from raw, mounts
)
select cast(plane_id as bigint) plane_id, sensor, {r6('cast(a / n as float)', 'a')}, {r6('cast(b / n as float)', 'b')}, {r6('cast(c / n as float)', 'c')}, {r6('d / n', 'd')} from moved""")
