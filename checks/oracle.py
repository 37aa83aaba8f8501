"""Brute-force SQL for each registered query, run by DuckDB over the same tables.

Written from the definitions (all pairs, full windows), not from the Spark plans.
"""

from __future__ import annotations

from . import fixture
from .registry import DRAWS, SEED

K = "recording_id, scenario_id"
FPS, THR = f"{fixture.FPS}e0", f"{fixture.THRESHOLD}e0"
PARAMS = ["theta1_deg", "theta2_deg", "end_speed_kmh"]

CTES: dict[str, str] = {
    "raw": fixture.RAW_TRACKS,
    "scn": fixture.SCENARIOS,
    "cfg": fixture.CLASS_ROWS,
    "tracks": """select recording_id, trackId as track_id, frame, xCenter as x, yCenter as y, heading,
        sqrt(xVelocity * xVelocity + yVelocity * yVelocity) as speed, length, width from raw""",
    "conf": """select scn.*, coalesce(cfg.anchor, 'pet') as anchor, coalesce(cfg.L, 10e0) as L_m, cfg.middle_cp_weight
        from scn left join cfg using (class)""",
    "once": """select * from tracks qualify row_number() over
        (partition by recording_id, track_id, frame order by x, y, heading, speed, length, width) = 1""",
    "roles": """select *, 'ego' as role, ego as track_id from conf union all select *, 'target', target from conf""",
    "win": """select r.recording_id, r.scenario_id, r.input_ordinal, r.role, r.track_id, o.frame, o.x, o.y, o.heading,
        o.speed, o.length, o.width from roles r join once o using (recording_id, track_id)
        where o.frame between r.min_frame and r.max_frame""",
    "summ": f"""select {K}, count(*) filter (role = 'ego') as ego_n, count(*) filter (role = 'target') as target_n,
        min(frame) filter (role = 'ego') as ego_lo, max(frame) filter (role = 'ego') as ego_hi,
        min(frame) filter (role = 'target') as target_lo, max(frame) filter (role = 'target') as target_hi,
        min_by(length, frame) filter (role = 'ego') as ego_length, min_by(width, frame) filter (role = 'ego') as ego_width,
        min_by(length, frame) filter (role = 'target') as target_length,
        min_by(width, frame) filter (role = 'target') as target_width,
        min_by(x, frame) filter (role = 'ego') as ego_x, min_by(y, frame) filter (role = 'ego') as ego_y,
        min_by(x, frame) filter (role = 'target') as target_x, min_by(y, frame) filter (role = 'target') as target_y
        from win group by all""",
    "gate": "select * from summ where ego_n >= 2 and target_n >= 2",
    "e": f"select win.* from win semi join gate using ({K}) where role = 'ego'",
    "t": f"select win.* from win semi join gate using ({K}) where role = 'target'",
    "same": f"""select {K}, frame, sqrt((e.x - t.x) * (e.x - t.x) + (e.y - t.y) * (e.y - t.y)) as distance,
        e.x as ex, e.y as ey, t.x as tx, t.y as ty from e join t using ({K}, frame)""",
    "simul": f"""select * from same qualify row_number() over (partition by {K} order by distance, frame) = 1""",
    "allpairs": f"""select {K}, (e.x - t.x) * (e.x - t.x) + (e.y - t.y) * (e.y - t.y) as d2,
        e.frame as ego_frame, t.frame as target_frame, e.x as ex, e.y as ey, t.x as tx, t.y as ty
        from e join t using ({K})""",
    "closest": f"""select * from allpairs
        qualify row_number() over (partition by {K} order by d2, ego_frame, target_frame) = 1""",
    "crossing": f"""select {K}, 'cross' as anchor_kind, target_frame as anchor_frame from allpairs
        qualify row_number() over (partition by {K} order by sqrt(d2), target_frame) = 1""",
    "mid": f"select {K}, cast(floor((ego_lo + ego_hi) / 2e0) as bigint) as probe from gate",
    "conflict": f"""select g.*, c.d2, c.ex as z1x, c.ey as z1y, c.tx as z2x, c.ty as z2y
        from gate g join closest c using ({K}) semi join simul using ({K}) where sqrt(c.d2) <= {THR}""",
    "body": f"""select {K}, 'ego' as role, frame, radians(heading) as h, z1x - x as dx, z1y - y as dy,
          ego_length as len, ego_width as wid, target_width as radius from e join conflict using ({K})
        union all select {K}, 'target', frame, radians(heading), z2x - x, z2y - y,
          target_length, target_width, ego_width from t join conflict using ({K})""",
    "inzone": f"""select {K}, role, frame, sqrt(power(greatest(abs(cos(h) * dx + sin(h) * dy) - len / 2, 0e0), 2)
          + power(greatest(abs(cos(h) * dy - sin(h) * dx) - wid / 2, 0e0), 2)) <= radius as inside from body""",
    "zones": f"""select {K}, min(frame) filter (role = 'ego' and inside) as enter1,
        max(frame) filter (role = 'ego' and inside) as exit1, min(frame) filter (role = 'target' and inside) as enter2,
        max(frame) filter (role = 'target' and inside) as exit2 from inzone group by all""",
    "cased": f"""select g.recording_id, g.scenario_id, s.distance, s.frame as sframe, s.ex, s.ey, s.tx, s.ty,
        c.d2, c.ex as z1x, c.ey as z1y, c.tx as z2x, c.ty as z2y, z.enter1, z.exit1, z.enter2, z.exit2,
        case when z.enter1 is null or z.enter2 is null then null when exit1 < enter2 then 1
             when exit2 < enter1 then 2 else 0 end as passer
        from gate g left join simul s using ({K}) left join (select * from closest semi join simul using ({K})) c using ({K})
        left join zones z using ({K})""",
    "pets": f"""select {K}, round_even(case passer when 1 then (enter2 - exit1) / {FPS} when 2 then -((enter1 - exit2) / {FPS})
          when 0 then 0e0 end, 3) as pet,
        case when distance is null then 'no_frame_overlap' when passer is null then 'no_conflict_zone_entry' end as reason,
        cast(passer as bigint) as first_passer,
        case passer when 1 then exit1 when 2 then exit2 when 0 then greatest(enter1, enter2) end as pet_frame1,
        case passer when 1 then enter2 when 2 then enter1 when 0 then least(exit1, exit2) end as pet_frame2,
        case when passer is not null then enter1 end as enter1, case when passer is not null then exit1 end as exit1,
        case when passer is not null then enter2 end as enter2, case when passer is not null then exit2 end as exit2,
        round_even(sqrt(d2), 4) as path_min_distance, z1x as zone1_x, z1y as zone1_y, z2x as zone2_x, z2y as zone2_y,
        round_even(distance, 4) as min_distance, sframe as min_distance_frame, ex as v1_mindist_x, ey as v1_mindist_y,
        tx as v2_mindist_x, ty as v2_mindist_y from cased""",
    "actor": f"""select {K}, case when pet is not null then 'pet' when min_distance_frame is not null then 'min_dist'
        else 'none' end as anchor, coalesce(pet_frame1, min_distance_frame) as crit_frame from pets""",
    "petanchor": f"""select {K}, anchor as anchor_kind, frame as anchor_frame from actor join t using ({K})
        where crit_frame is not null
        qualify row_number() over (partition by {K} order by abs(frame - crit_frame), frame) = 1""",
    "mindist": f"select {K}, 'min_dist' as anchor_kind, frame as anchor_frame from simul",
    "given": f"""select {K}, 'given' as anchor_kind, anchor_frame from conf semi join gate using ({K})
        where anchor_frame is not null""",
    "found": f"""select * from given union all
        select {K}, a.anchor_kind, a.anchor_frame from conf join (
          select *, 'pet' as anchor from petanchor union all select *, 'cross' from crossing
          union all select *, 'min_dist' from mindist) a using ({K}, anchor) where conf.anchor_frame is null""",
}


def disk(prefix: str, anchors: str) -> dict[str, str]:
    """CTEs for the circular window around the anchors of another CTE."""
    p = prefix
    return {
        f"{p}a": f"""select {K}, a.anchor_kind, a.anchor_frame, conf.L_m from {anchors} a join conf using ({K})""",
        f"{p}q": f"""select {p}a.*, t.x as qc_x, t.y as qc_y, t.speed from {p}a left join t
            on t.recording_id = {p}a.recording_id and t.scenario_id = {p}a.scenario_id and t.frame = anchor_frame""",
        f"{p}d": f"""select {K}, q.anchor_frame, q.L_m, q.qc_x, q.qc_y, t.frame, t.x, t.y,
            sqrt((t.x - qc_x) * (t.x - qc_x) + (t.y - qc_y) * (t.y - qc_y)) as d,
            lag(t.frame) over w as pf, lag(t.x) over w as px, lag(t.y) over w as py,
            lead(t.frame) over w as nf, lead(t.x) over w as nx, lead(t.y) over w as ny
            from t join {p}q q using ({K}) where qc_x is not null window w as (partition by {K} order by t.frame)""",
        f"{p}s": f"""(select {K}, 'in' as side, L_m, qc_x, qc_y, nf as af, nx as ax, ny as ay, frame as bf, x as bx, y as b_y
              from {p}d where d >= L_m and frame < anchor_frame
              qualify row_number() over (partition by {K} order by frame desc) = 1)
            union all (select {K}, 'out', L_m, qc_x, qc_y, pf, px, py, frame, x, y from {p}d where d >= L_m and frame > anchor_frame
              qualify row_number() over (partition by {K} order by frame) = 1)""",
        f"{p}r": f"""select *, (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) as qa,
            2 * ((bx - ax) * (ax - qc_x) + (b_y - ay) * (ay - qc_y)) as qb,
            (ax - qc_x) * (ax - qc_x) + (ay - qc_y) * (ay - qc_y) - L_m * L_m as qcc from {p}s""",
        f"{p}f": f"""select *, least(greatest((-qb + sqrt(greatest(qb * qb - 4 * qa * qcc, 0e0))) / nullif(2 * qa, 0e0), 0e0), 1e0) as s
            from {p}r where qa > 0""",
        f"{p}x": f"""select {K}, max(ax + s * (bx - ax)) filter (side = 'in') as qm_x,
            max(ay + s * (b_y - ay)) filter (side = 'in') as qm_y, max(af + s * (bf - af)) filter (side = 'in') as t_in_frame,
            max(ax + s * (bx - ax)) filter (side = 'out') as qp_x, max(ay + s * (b_y - ay)) filter (side = 'out') as qp_y,
            max(af + s * (bf - af)) filter (side = 'out') as t_out_frame from {p}f group by all""",
        f"{p}disk": f"""select q.*, qm_x, qm_y, t_in_frame, qp_x, qp_y, t_out_frame,
            case when qc_x is null then 'no_anchor_sample' when qm_x is null and qp_x is null then 'both_unavailable'
              when qm_x is null then 'q_in_unavailable' when qp_x is null then 'q_out_unavailable' else 'ok' end as status
            from {p}q q left join {p}x using ({K})""",
    }


def angles(prefix: str) -> dict[str, str]:
    p = prefix
    return {
        f"{p}g": f"""select d.*, sqrt((qm_x - target_x) * (qm_x - target_x) + (qm_y - target_y) * (qm_y - target_y)) as l0,
            sqrt((qc_x - qm_x) * (qc_x - qm_x) + (qc_y - qm_y) * (qc_y - qm_y)) as L1,
            sqrt((qp_x - qc_x) * (qp_x - qc_x) + (qp_y - qc_y) * (qp_y - qc_y)) as L2, target_x, target_y, hx, hy
            from {p}disk d join gate using ({K}) left join heading using ({K}) where d.status = 'ok'""",
        f"{p}u": f"""select *, case when l0 >= 1 then (qm_x - target_x) / l0 else hx end as u1_x,
            case when l0 >= 1 then (qm_y - target_y) / l0 else hy end as u1_y,
            case when l0 >= 1 then 'init_pt' else 'start_heading' end as u1_source from {p}g""",
        f"{p}geom": f"""select {K}, u1_x, u1_y, u1_source, L1, L2,
            degrees(atan2(u1_x * (qc_y - qm_y) - u1_y * (qc_x - qm_x), u1_x * (qc_x - qm_x) + u1_y * (qc_y - qm_y))) as theta1_deg,
            degrees(atan2((qc_x - qm_x) * (qp_y - qc_y) - (qc_y - qm_y) * (qp_x - qc_x),
                          (qc_x - qm_x) * (qp_x - qc_x) + (qc_y - qm_y) * (qp_y - qc_y))) as theta2_deg
            from {p}u where least(L1, L2) >= 1""",
    }


CTES |= {
    "seg": f"""select *, coalesce(sqrt((bx - x) * (bx - x) + (b_y - y) * (b_y - y)), 0e0) as len from (
        select {K}, frame, x, y, lead(x) over w as bx, lead(y) over w as b_y from t
        window w as (partition by {K} order by frame)) p""",
    "cum": f"""select *, sum(len) over (partition by {K} order by frame) - len as s0, sum(len) over (partition by {K}) as total
        from seg""",
    "arc": f"""select q.recording_id, q.scenario_id, q.i,
        c.x + case when c.len > 0 then least((q.s - c.s0) / c.len, 1e0) * (c.bx - c.x) else 0e0 end as x,
        c.y + case when c.len > 0 then least((q.s - c.s0) / c.len, 1e0) * (c.b_y - c.y) else 0e0 end as y
        from (select {K}, i, i * total / 199e0 as s
              from (select distinct {K}, total from cum) a, (select unnest(range(200)) as i) n) q
        asof join cum c on c.recording_id = q.recording_id and c.scenario_id = q.scenario_id and c.s0 <= q.s""",
    "arcd": f"""select *, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0e0) as d from arc
        window w as (partition by {K} order by i)""",
    "arcs": f"select *, sum(d) over (partition by {K} order by i) as s from arcd",
    "arch": f"select *, least(2e0, max(s) over (partition by {K}) * 0.5e0) as reach from arcs",
    "ends": f"""select {K}, min(x) filter (i = 0) as ax, min(y) filter (i = 0) as ay,
        min_by(x, i) filter (i >= 1 and s >= reach) as bx, min_by(y, i) filter (i >= 1 and s >= reach) as b_y
        from arch group by all""",
    "heading": f"""select {K}, (bx - ax) / (sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) + 1e-9) as hx,
        (b_y - ay) / (sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) + 1e-9) as hy from ends""",
    **disk("m", "mindist"), **angles("m"), **disk("f", "found"), **angles("f"),
    "params": f"""select c.recording_id, c.scenario_id, c.input_ordinal, c.class, c.ego, c.target, c.min_frame, c.max_frame, c.base_xosc,
        case when d.anchor_kind = 'given' then 'given' else c.anchor end as anchor_method, c.L_m,
        case when g.recording_id is null then 'no_track' when d.recording_id is null then 'no_anchor'
          when d.status = 'ok' and f.L1 is null then 'degenerate_geometry' else d.status end as status,
        d.anchor_kind, coalesce(d.anchor_frame, c.anchor_frame) as anchor_frame, d.qc_x, d.qc_y, d.qm_x, d.qm_y,
        d.t_in_frame, d.qp_x, d.qp_y, d.t_out_frame, f.u1_x, f.u1_y, f.u1_source, f.L1, f.L2, f.theta1_deg, f.theta2_deg,
        case when f.L1 is not null then d.speed * 3.6 end as end_speed_kmh,
        case when f.L1 is not null then c.middle_cp_weight end as middle_cp_weight
        from conf c left join gate g using ({K}) left join fdisk d using ({K}) left join fgeom f using ({K})""",
    "ok": "select * from params where status = 'ok'",
    "mom": "select class, count(*) as n, " + ", ".join(
        f"avg({c}) as m{j}, stddev_pop({c}) as r{j}" for j, c in enumerate(PARAMS, 1)) + " from ok group by class",
    "sig": "select class, n, m1, m2, m3, " + ", ".join(
        f"case when r{j} < 1e-12 then 1e0 else r{j} end as sd{j}" for j in (1, 2, 3)) + ", ("
        + " + ".join(f"case when r{j} < 1e-12 then 0e0 else 1e0 end" for j in (1, 2, 3)) + ") / 3 as sigma from mom",
    "fit": "select * from sig where n >= 2 and sigma > 0",
    "z": f"""select ok.recording_id, ok.scenario_id, ok.input_ordinal, class, n,
        row_number() over (partition by class order by input_ordinal) - 1 as kernel, """ + ", ".join(
        f"({c} - m{j}) / sd{j} as z{j}" for j, c in enumerate(PARAMS, 1)) + " from ok join fit using (class)",
    "pair": """select a.class, a.n, a.kernel, power(a.z1 - b.z1, 2) + power(a.z2 - b.z2, 2) + power(a.z3 - b.z3, 2) as d2
        from z a join z b on a.class = b.class and a.kernel <> b.kernel""",
    "g0": """select class, n, k, exp(lo + (hi - lo) * k / 59e0) as h from (
        select class, n, ln(h0 / 20) as lo, ln(h0 * 20) as hi from (
          select class, n, sigma * power(4e0 / (5 * n), 1e0 / 7) as h0 from fit) a) b, (select unnest(range(60)) as k) c""",
}


def ll_round(r: int) -> dict[str, str]:
    """Likelihood on grid g<r>, its best point with neighbours, and the next, finer grid."""
    size = 60 if r == 0 else 16
    return {
        f"l{r}": f"""select class, n, k, h, sum(ln(greatest(s / ((n - 1) * power(2 * pi(), 1.5) * power(h, 3)), 1e-300))) as ll
            from (select p.class, p.n, g.k, g.h, p.kernel, sum(exp(-p.d2 / (2 * g.h * g.h))) as s
                  from pair p join g{r} g using (class) group by all) q group by class, n, k, h""",
        f"b{r}": f"select class, min(k) as k from (select *, max(ll) over (partition by class) as top from l{r}) q where ll = top group by class",
        f"c{r}": f"""select b.class, l.n, b.k as kb, ka.k as k0, kc.k as k2, ln(ka.h) as ha, ln(l.h) as hb, ln(kc.h) as hc,
            ka.ll as la, l.ll as lb, kc.ll as lc from b{r} b join l{r} l on l.class = b.class and l.k = b.k
            join l{r} ka on ka.class = b.class and ka.k = greatest(b.k - 1, 0)
            join l{r} kc on kc.class = b.class and kc.k = least(b.k + 1, {size - 1})""",
        f"g{r + 1}": f"""select class, n, k, exp(ha + (hc - ha) * k / 15e0) as h from c{r}, (select unnest(range(16)) as k) s""",
    }


for _r in range(4):
    CTES |= ll_round(_r)


def _hash(stream: str) -> str:
    return (f"((cast(cast('0x' || substr(md5(concat_ws(':', '{SEED}', cast(draw as varchar), '{stream}')), 1, 8) as ubigint)"
            " as double) + 0.5) / 4294967296.0)")


def _normal(j: int) -> str:
    return f"(sqrt(-2 * ln({_hash(f'{j}a')})) * cos({_hash(f'{j}b')} * 2 * pi()))"


CTES |= {
    "band": """select class, n, round(exp(case when k0 < kb and kb < k2 and la - 2 * lb + lc < 0
          then hb + (hc - ha) / 2 * (la - lc) / (2 * (la - 2 * lb + lc)) else hb end), 5) as h from c3""",
    # An own search: four dense grids of 201 points, each around the best point of the one before.
    "dense0": "select class, n, ln(h0) as best, 3e0 as reach from (select class, n, sigma * power(4e0 / (5 * n), 1e0 / 7) as h0 from fit) f",
    **{f"dense{r}": f"""select class, n, max_by(lh, ll) as best, max(reach) / 50 as reach from (
        select class, n, lh, reach, sum(ln(greatest(s / ((n - 1) * power(2 * pi(), 1.5) * exp(3 * lh)), 1e-300))) as ll
        from (select p.class, p.n, g.lh, g.reach, p.kernel, sum(exp(-p.d2 / (2 * exp(2 * g.lh)))) as s from pair p
              join (select class, best + reach * k / 100e0 as lh, reach from dense{r - 1}, (select unnest(range(-100, 101)) as k) i) g using (class)
              group by all) q group by all) l group by class, n""" for r in (1, 2, 3, 4)},
    "draws": f"""select class, h, n, draw, {', '.join(f'm{j}, sd{j}' for j in (1, 2, 3))},
        cast(floor({_hash('0')} * n) as bigint) as kernel,
        {', '.join(f'{_normal(j)} as e{j}' for j in (1, 2, 3))}
        from (select * from fit join band using (class, n)) f, (select unnest(range(1, {DRAWS + 1})) as draw) d""",
    "centers": "select ok.*, z.kernel, z.z1, z.z2, z.z3 from ok join z using (recording_id, scenario_id, class)",
    "drawn": "select c.* exclude (kernel), d.draw, d.h, d.kernel, " + ", ".join(
        f"(c.z{j} + d.h * d.e{j}) * d.sd{j} + d.m{j} as new{j}" for j in (1, 2, 3))
        + " from draws d join centers c using (class, kernel)",
    "around": "select d.class, d.draw, " + ", ".join(
        f"(c.z{j} + d.h * d.e{j}) * d.sd{j} + d.m{j} as {c}" for j, c in enumerate(PARAMS, 1))
        + " from draws d join centers c on c.class = d.class and c.kernel = 0",
    "samples": f"""select format('{{}}__seed{SEED}__draw{{:06d}}', class, draw) as sample_id, recording_id, scenario_id, class,
        base_xosc, qm_x, qm_y, u1_x, u1_y, L1, L2, middle_cp_weight, new1 as theta1_deg, new2 as theta2_deg,
        greatest(0e0, new3) as end_speed_kmh, theta1_deg as center_theta1_deg, theta2_deg as center_theta2_deg,
        end_speed_kmh as center_end_speed_kmh, h as kde_bandwidth from drawn""",
}


def _cps(source: str, name: str) -> str:
    """Control points of the parameter rows in ``source`` (before rounding)."""
    return f"""select *, qm_x as p1_x, qm_y as p1_y, c_x as p2_x, c_y as p2_y,
        c_x + L2 * (cos(radians(theta1_deg + theta2_deg)) * u1_x - sin(radians(theta1_deg + theta2_deg)) * u1_y) as p3_x,
        c_y + L2 * (sin(radians(theta1_deg + theta2_deg)) * u1_x + cos(radians(theta1_deg + theta2_deg)) * u1_y) as p3_y
        from (select *, {name} as name,
          qm_x + L1 * (cos(radians(theta1_deg)) * u1_x - sin(radians(theta1_deg)) * u1_y) as c_x,
          qm_y + L1 * (sin(radians(theta1_deg)) * u1_x + cos(radians(theta1_deg)) * u1_y) as c_y from {source}) a"""


CTES |= {"cps": _cps("ok", "scenario_id"), "scps": _cps("samples", "sample_id")}


def _points(source: str) -> str:
    parts = [f"""select *, {i} as point, '{role}' as role, round(p{i}_x, 4) as x, round(p{i}_y, 4) as y,
        {'coalesce(middle_cp_weight, 5e0)' if i == 2 else '5e0'} as weight from {source}"""
             for i, role in ((1, "q_in"), (2, "q_c"), (3, "q_out"))]
    return " union all ".join(parts)


def _with(final: str) -> str:
    """Prefix ``final`` with the CTEs it needs, in order."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[A-Za-z_]\w*", text)):
            if word in CTES and word not in needed and re.search(rf"\b(from|join|,)\s+{word}\b", text):
                needed.add(word)
                visit(CTES[word])

    visit(final)
    body = ",\n".join(f"{name} as materialized ({sql})" for name, sql in CTES.items() if name in needed)
    return f"with {body}\n{final}"


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0e0 as {c.split('.')[-1]}" for c in cols)


POINTS = ["qc_x", "qc_y", "qm_x", "qm_y", "t_in_frame", "qp_x", "qp_y", "t_out_frame"]
GEOM = f"{_r('u1_x', 'u1_y')}, u1_source, {_r('L1', 'L2', 'theta1_deg', 'theta2_deg')}"
RAW = f"recording_id, trackId, frame, {_r('xCenter', 'yCenter', 'heading', 'xVelocity', 'yVelocity', 'length', 'width')}"

FINAL: dict[str, str] = {
    "track_scan": f"select {RAW} from raw",
    "track_normalize": f"select recording_id, track_id, frame, {_r('x', 'y', 'heading', 'speed', 'length', 'width')} from tracks",
    "track_scan_referenced": f"""select {RAW} from raw where (recording_id, trackId) in
        (select recording_id, ego from scn union select recording_id, target from scn)""",
    "class_config_join": f"select {K}, class, anchor as anchor_method, L_m, middle_cp_weight from conf",
    "window_slice": f"select {K}, role, track_id, frame, {_r('x', 'y', 'heading', 'speed')} from win",
    "pair_windows": f"""select {K}, ego_n, target_n, ego_lo, ego_hi, target_lo, target_hi, ego_length, target_width from gate""",
    "simultaneous_distance": f"select {K}, frame, {_r('distance')} from same",
    "anchor_min_dist": f"select {K}, frame as anchor_frame, {_r('distance')} from simul",
    "closest_pair": f"select {K}, {_r('d2')}, ego_frame, target_frame from closest",
    "anchor_cross": "select * from crossing",
    "nearest_frame": f"""select {K}, frame, abs(frame - probe) as gap from t join mid using ({K})
        qualify row_number() over (partition by {K} order by abs(frame - probe), frame) = 1""",
    "zone_overlap": f"select {K}, role, frame, inside from inzone",
    "zone_enter_exit": "select * from zones",
    "pet": f"""select {K}, {_r('pet')}, reason, first_passer, pet_frame1, pet_frame2, enter1, exit1, enter2, exit2,
        {_r('path_min_distance', 'zone1_x', 'zone1_y', 'zone2_x', 'zone2_y', 'min_distance')}, min_distance_frame,
        {_r('v1_mindist_x', 'v1_mindist_y', 'v2_mindist_x', 'v2_mindist_y')} from pets""",
    "pet_positions": "select " + K + ", " + ", ".join(
        f"max({c}) filter (v = {v} and p = {p}) as v{v}_pet{p}_{c}" for v in (1, 2) for p in (1, 2) for c in ("x", "y")) + f"""
        from (select {K}, v, p, x, y from (select *, case p when 1 then pet_frame1 else pet_frame2 end as probe
                from pets, (values (1), (2)) n(p) where pet is not null) a
              join (select *, 1 as v from e union all select *, 2 from t) s using ({K})
              qualify row_number() over (partition by {K}, v, p order by abs(frame - probe), frame) = 1) q group by all""",
    "actor_anchor": f"""select {K}, a.anchor, a.crit_frame, {_r('n.crit_x', 'n.crit_y')} from actor a left join (
        select {K}, x as crit_x, y as crit_y from actor join t using ({K}) where crit_frame is not null
        qualify row_number() over (partition by {K} order by abs(frame - crit_frame), frame) = 1) n using ({K})""",
    "anchor_pet": "select * from petanchor",
    "anchor_given": "select * from given",
    "find_anchor": "select * from found",
    "circle_crossing": f"""select {K}, round(qm_x, 6) + 0e0 as in_x, round(qm_y, 6) + 0e0 as in_y, {_r('t_in_frame')},
        round(qp_x, 6) + 0e0 as out_x, round(qp_y, 6) + 0e0 as out_y, {_r('t_out_frame')} from mdisk""",
    "disk_points": f"select {K}, status, {_r(*POINTS)} from mdisk",
    "arc_resample": f"select {K}, i, {_r('x', 'y')} from arc",
    "start_heading": f"select {K}, {_r('hx', 'hy')} from heading",
    "theta_geometry": f"select {K}, {GEOM} from mdisk left join mgeom using ({K}) where status = 'ok'",
    "signed_angle": f"""select {K}, round(degrees(atan2(ego_x * target_y - ego_y * target_x,
        ego_x * target_x + ego_y * target_y)), 6) + 0e0 as angle_deg from gate""",
    "theta_to_cps": f"select {K}, {_r('p1_x', 'p1_y', 'p2_x', 'p2_y', 'p3_x', 'p3_y')} from cps",
    "extract_params": f"""select {K}, class, ego, target, min_frame, max_frame, base_xosc, anchor_method, L_m, status,
        anchor_kind, anchor_frame, {_r(*POINTS)}, {GEOM}, {_r('end_speed_kmh')}, middle_cp_weight from params""",
    "extract_status": f"select {K}, status from params",
    "status_counts": "select status, count(*) as n from params group by status",
    "kde_classes": f"""select class, n, (select count(*) from ok o where o.class = sig.class and ({" or ".join(f"o.{p} is null" for p in PARAMS)})) as missing_values,
        n >= 2 and sigma > 0 as usable, case when n < 2 then 'needs_two_rows'
        when sigma = 0 then 'zero_variance' end as reason from sig""",
    "class_order": "select class, min(input_ordinal) as first_seen from ok group by class",
    "kde_standardize": f"select {K}, class, {_r('z1', 'z2', 'z3')} from z",
    "kde_loo_density": f"""select z.recording_id, z.scenario_id, class, round(s / ((n - 1) * power(2 * pi(), 1.5) * power(h, 3)), 6) + 0e0 as density
        from z join (select p.class, p.kernel, b.h, sum(exp(-p.d2 / (2 * b.h * b.h))) as s from pair p join band b using (class)
                     group by all) q using (class, kernel)""",
    "kde_loo_grid": f"select class, k, {_r('h', 'll')} from l0",
    "kde_bandwidth": "select class, n, round(exp(best), 5) as h from dense4",
    "kernel_index": f"select {K}, class, row_number() over (partition by class order by input_ordinal) - 1 as kernel from ok",
    "kde_sample": "select class, draw, kernel, " + ", ".join(
        f"round(new{j}, 6) + 0e0 as {c}" for j, c in enumerate(PARAMS, 1)) + " from drawn",
    "kde_conditional": f"select class, draw, {_r(*PARAMS)} from around",
    "sample_table": f"""select sample_id, {K}, class, {_r(*PARAMS, *[f'center_{c}' for c in PARAMS], 'kde_bandwidth')}
        from samples""",
    "control_points": f"select recording_id, name, base_xosc, point, role, {_r('x', 'y')}, weight from ({_points('cps')}) q",
    "sample_control_points": f"select name, point, role, {_r('x', 'y')}, weight, {_r('end_speed_kmh')} from ({_points('scps')}) q",
    "limit_ok": f"select {K}, class, {_r(*PARAMS)} from ok order by input_ordinal limit 25",
    "ego_replay": f"""select {K}, frame, round((frame - min(frame) over (partition by {K})) / {FPS}, 6) + 0e0 as time_s,
        cast(round(cast(x as decimal(18, 6)), 4) as double) as x, cast(round(cast(y as decimal(18, 6)), 4) as double) as y,
        round(radians(heading), 5) + 0e0 as heading_rad
        from win where role = 'ego'""",
    "run_end_time": f"select {K}, round((max_frame - min_frame) / {FPS} + 1e0, 3) + 0e0 as t_end_s from scn",
    "run_log": f"""select concat_ws('/', recording_id, scenario_id) as file, role as entity, round(frame / {FPS}, 6) as time_s,
        100e0 + frame as frame, {_r('x', 'y')}, round(degrees(heading * 0.01e0), 6) + 0e0 as heading_deg,
        round(speed, 6) + 0e0 as speed_mps from win w
        where exists (select 1 from win o where (o.recording_id, o.scenario_id, o.frame) = (w.recording_id, w.scenario_id, w.frame) and o.role <> w.role)""",
}

FINAL |= {
    "track_parquet_files": FINAL["track_normalize"],
    "track_csv_files": FINAL["track_normalize"],
    "scenario_csv_files": f"""select {K}, class, ego, target, min_frame, max_frame, anchor_frame, base_xosc,
        row_number() over (partition by recording_id order by input_ordinal) as place from scn""",
    "params_parquet_files": FINAL["extract_params"],
    "samples_csv_files": FINAL["sample_table"],
    "sample_params": f"select sample_id, {K}, class, {_r(*[f'center_{c}' for c in PARAMS], 'kde_bandwidth')} from samples",
    "run_log_files": FINAL["run_log"].replace("concat_ws('/'", "concat_ws('-'"),
}

SQL: dict[str, str] = {name: _with(final) for name, final in FINAL.items()}
