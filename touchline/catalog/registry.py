"""Registry of queries, their SQL counterparts, and the SQL building blocks."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources import star_tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_parts(sql)
        return fn

    return add


def r6(c) -> Column:
    """Six decimals by the same arithmetic as :func:`R`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def R(expression: str) -> str:
    return f"floor(({expression})*1000000::DOUBLE+0.5::DOUBLE)/1000000::DOUBLE"


_SLOTS = ", ".join(f"('{t}',{s},{p},{q})" for t, s, p, q in S.SLOTS)
_LINE = (
    "row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)"
)

#: name -> (names it needs, body)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "msz": ((), "SELECT l_suppkey % 4 AS match_id, count(*) AS n FROM lineitem GROUP BY 1"),
    "fr0": ((), f"""SELECT l_suppkey % 4 AS match_id, l_quantity, l_discount, l_tax, l_partkey, {_LINE} AS frame,
        count(*) OVER (PARTITION BY l_suppkey % 4) AS n FROM lineitem"""),
    "frames": (("fr0",), """SELECT match_id, CASE WHEN 2*frame <= n THEN 1 ELSE 2 END AS period, frame,
        frame::DOUBLE/25::DOUBLE AS time_s,
        CASE WHEN l_tax <> 0 THEN (l_quantity-25.5::DOUBLE)/24.5::DOUBLE*52.5::DOUBLE END AS ball_x,
        CASE WHEN l_tax <> 0 THEN (l_discount-0.05::DOUBLE)/0.05::DOUBLE*34.0::DOUBLE END AS ball_y,
        frame AS row_no, CASE WHEN 2*frame <= n THEN frame ELSE frame - n//2 END AS period_row, l_partkey AS pk FROM fr0"""),
    "sl": ((), f"SELECT * FROM (VALUES {_SLOTS}) t(team,slot,p,q)"),
    "pos": (("frames", "sl"), """SELECT match_id, period, frame, period_row, team, slot, team||'_'||slot AS player_id,
        CASE WHEN (pk+slot) % 11 <> 0 THEN ((pk*p + frame*q) % 1050)::DOUBLE/10::DOUBLE-52.5::DOUBLE END AS x,
        CASE WHEN (pk+slot) % 11 <> 0 THEN ((pk*q + frame*p) % 680)::DOUBLE/10::DOUBLE-34.0::DOUBLE END AS y
        FROM frames, sl"""),
    "ev": (("msz",), """SELECT *, start_frame + dur AS end_frame, start_frame::DOUBLE/25::DOUBLE AS start_time_s,
        (start_frame+dur)::DOUBLE/25::DOUBLE AS end_time_s, CASE WHEN 2*start_frame <= n THEN 1 ELSE 2 END AS period,
        type IN ('pass','carry','shot','recovery','ball_lost') AS on_ball,
        type IN ('set_piece','ball_out','card','fault_received') AS dead FROM (
        SELECT user_id % 4 AS match_id, event_id AS event_seq, CASE WHEN user_id % 8 < 4 THEN 'home' ELSE 'away' END AS team,
        CASE WHEN event_id % 10 = 3 THEN 'challenge' WHEN event_id % 10 = 7 THEN 'ball_lost' WHEN event_type='click' THEN 'pass'
          WHEN event_type='view' THEN 'carry' WHEN event_type='purchase' THEN 'shot' WHEN event_type='signup' THEN 'recovery'
          ELSE 'ball_out' END AS type,
        1 + (event_id * 13) % (SELECT min(n) FROM msz) AS start_frame, event_id % 40 AS dur,
        CASE WHEN event_id % 17 <> 0 THEN ((event_id*37) % 1050)::DOUBLE/10::DOUBLE-52.5::DOUBLE END AS start_x,
        CASE WHEN event_id % 17 <> 0 THEN ((event_id*53) % 680)::DOUBLE/10::DOUBLE-34.0::DOUBLE END AS start_y,
        CASE WHEN event_id % 17 <> 0 THEN ((event_id*41+user_id) % 1050)::DOUBLE/10::DOUBLE-52.5::DOUBLE END AS end_x,
        CASE WHEN event_id % 17 <> 0 THEN ((event_id*59+user_id) % 680)::DOUBLE/10::DOUBLE-34.0::DOUBLE END AS end_y
        FROM events) JOIN msz USING (match_id)"""),
    "ori": ((), """SELECT m AS match_id, p::INT AS period, t AS team, CASE WHEN (t='home')=(p=1) THEN 1 ELSE -1 END AS sign
        FROM range(4) a(m), range(1,3) b(p), (VALUES ('home'),('away')) c(t)"""),
    "onb": (("ev",), """SELECT *, row_number() OVER w AS rn, CASE WHEN lag(team) OVER w = team THEN 0 ELSE 1 END AS chg
        FROM ev WHERE on_ball WINDOW w AS (PARTITION BY match_id ORDER BY start_frame, event_seq)"""),
    "rn0": (("onb",), "SELECT *, sum(chg) OVER (PARTITION BY match_id ORDER BY rn) AS run_id FROM onb"),
    "runs": (("rn0",), """SELECT match_id, team, type, start_frame, event_seq,
        min(start_frame) OVER (PARTITION BY match_id, run_id) AS run_start,
        row_number() OVER (PARTITION BY match_id, run_id ORDER BY rn) AS run_events FROM rn0"""),
    "r1": (("runs",), "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY match_id, start_frame ORDER BY event_seq DESC) = 1"),
    "e1": (("ev",), "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY match_id, start_frame ORDER BY event_seq DESC) = 1"),
    "d1": (("ev",), "SELECT * FROM ev WHERE dead OR on_ball QUALIFY row_number() OVER (PARTITION BY match_id, start_frame ORDER BY event_seq DESC) = 1"),
    "rp": (("frames", "ev"), """SELECT f.match_id, f.frame, count(*) AS n FROM frames f JOIN ev e ON f.match_id = e.match_id
        AND e.start_frame BETWEEN f.frame-250 AND f.frame WHERE e.type IN ('pass','carry') GROUP BY 1, 2"""),
    "ctx": (("frames", "r1", "e1", "d1", "rp"), """SELECT f.*, r.team AS possession_team,
        CASE WHEN r.team IS NULL THEN 0::DOUBLE ELSE (f.frame - r.run_start)::DOUBLE/25::DOUBLE END AS possession_duration_s,
        coalesce(r.run_events, 0) AS possession_event_count, coalesce(e.dead, false) AS is_dead_ball,
        coalesce(e.end_frame > f.frame, false) AS event_in_flight, coalesce(d.dead, false) AS in_stoppage,
        coalesce(rp.n, 0) AS recent_pass_count
        FROM frames f ASOF LEFT JOIN r1 r ON f.match_id = r.match_id AND f.frame >= r.start_frame
        ASOF LEFT JOIN e1 e ON f.match_id = e.match_id AND f.frame >= e.start_frame
        ASOF LEFT JOIN d1 d ON f.match_id = d.match_id AND f.frame >= d.start_frame
        LEFT JOIN rp ON f.match_id = rp.match_id AND f.frame = rp.frame"""),
    "ins": (("ctx", "ori"), """SELECT c.*, coalesce(o.sign*ball_x BETWEEN 36.0::DOUBLE AND 52.5::DOUBLE AND abs(ball_y)<=20.16::DOUBLE, false) AS inside
        FROM ctx c LEFT JOIN ori o ON o.match_id = c.match_id AND o.period = c.period AND o.team = c.possession_team"""),
    "ent": (("ins",), """SELECT match_id, possession_team AS team, period, time_s, frame, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS rn
        FROM (SELECT *, inside AND NOT lag(inside,1,false) OVER (PARTITION BY match_id ORDER BY frame) AS entry FROM ins) WHERE entry"""),
    "rec": (("ent",), """SELECT match_id, rn, team, period, time_s, time_s AS anchor FROM ent WHERE rn = 1
        UNION ALL SELECT e.match_id, e.rn, e.team, e.period, e.time_s,
        CASE WHEN e.team = r.team AND e.time_s - r.anchor <= 10 THEN r.anchor ELSE e.time_s END
        FROM rec r JOIN ent e ON e.match_id = r.match_id AND e.rn = r.rn + 1"""),
    "eps": (("rec",), """SELECT match_id, anchor AS entry_time_s, first(team) AS team, min(period) AS period, count(*) AS n_entries,
        row_number() OVER (PARTITION BY match_id ORDER BY anchor) - 1 AS episode_id FROM rec GROUP BY match_id, anchor"""),
    "clu": (("ins",), """SELECT *, sum(CASE WHEN frame > 1 AND possession_team IS DISTINCT FROM prev THEN 1 ELSE 0 END)
        OVER (PARTITION BY match_id ORDER BY frame)::BIGINT AS cluster_id FROM (
        SELECT *, lag(possession_team) OVER (PARTITION BY match_id ORDER BY frame) AS prev FROM ins)"""),
    "smp": (("clu", "eps"), """SELECT c.match_id, c.period, c.frame, c.row_no, c.period_row, c.time_s, c.possession_team AS team, c.cluster_id,
        count(e.episode_id) > 0 AS hit, coalesce(arg_min(e.episode_id, e.entry_time_s), -1) AS episode_id
        FROM clu c LEFT JOIN eps e ON e.match_id = c.match_id AND e.team = c.possession_team
          AND e.entry_time_s > c.time_s AND e.entry_time_s <= c.time_s + 5::DOUBLE
        WHERE c.period_row-1 >= 125 AND (c.period_row-1-125) % 12 = 0 AND NOT c.in_stoppage AND c.possession_team IS NOT NULL AND NOT c.inside
        GROUP BY ALL"""),
    # --- features -----------------------------------------------------------------------
    "hyp": (("ctx", "ori"), """SELECT c.*, o.team AS att, o.sign, ball_x*o.sign AS bx, ball_y*o.sign AS by_ FROM ctx c JOIN ori o USING (match_id, period)"""),
    "bv0": (("frames",), """SELECT match_id, period, frame, period_row,
        (ball_x-lag(ball_x,3) OVER w)/0.12::DOUBLE AS vx, (ball_y-lag(ball_y,3) OVER w)/0.12::DOUBLE AS vy FROM frames
        WINDOW w AS (PARTITION BY match_id, period ORDER BY period_row)"""),
    "bv": (("bv0",), """SELECT match_id, frame, CASE WHEN period_row<=3 THEN max(CASE WHEN period_row=4 THEN vx END) OVER w ELSE vx END AS vx,
        CASE WHEN period_row<=3 THEN max(CASE WHEN period_row=4 THEN vy END) OVER w ELSE vy END AS vy FROM bv0
        WINDOW w AS (PARTITION BY match_id, period)"""),
    "pv0": (("pos",), """SELECT *, (x-lag(x,3) OVER (PARTITION BY match_id, period, team, slot ORDER BY period_row))/0.12::DOUBLE AS v FROM pos"""),
    "pv": (("pv0",), """SELECT *, CASE WHEN period_row<=3 THEN max(CASE WHEN period_row=4 THEN v END) OVER (PARTITION BY match_id, period, team, slot) ELSE v END AS vx
        FROM pv0"""),
    "pl": (("hyp", "pv"), """SELECT h.match_id, h.frame, h.att, h.bx, h.by_, p.team = h.att AS attacks, p.slot, p.slot = 0 AS gk,
        p.x*h.sign AS x, p.y*h.sign AS y, p.vx*h.sign AS vx, sqrt((p.x*h.sign-h.bx)*(p.x*h.sign-h.bx)+(p.y*h.sign-h.by_)*(p.y*h.sign-h.by_)) AS d
        FROM hyp h JOIN pv p ON h.match_id = p.match_id AND h.frame = p.frame"""),
    "edge": (("hyp",), """SELECT match_id, att, period, frame, time_s, inb AND NOT lag(inb,1,true) OVER (PARTITION BY match_id, period, att ORDER BY frame) AS entry
        FROM (SELECT *, coalesce(bx BETWEEN 36.0::DOUBLE AND 52.5::DOUBLE AND abs(by_)<=20.16::DOUBLE,false) AS inb FROM hyp)"""),
    "hist": (("edge",), """SELECT match_id, att, frame,
        sum(CASE WHEN entry THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, period, att ORDER BY round(time_s*1000000)::BIGINT
          RANGE BETWEEN 120000000 PRECEDING AND CURRENT ROW)::BIGINT - CASE WHEN entry THEN 1 ELSE 0 END AS entries,
        least(120::DOUBLE, coalesce(time_s - max(CASE WHEN entry THEN time_s END) OVER (PARTITION BY match_id, period, att ORDER BY frame
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 120::DOUBLE)) AS since FROM edge"""),
    "cen": (("pl",), """SELECT match_id, frame, att, coalesce(avg(x) FILTER (NOT attacks AND NOT gk),0) AS cx, coalesce(avg(y) FILTER (NOT attacks),0) AS cy
        FROM pl GROUP BY ALL"""),
    # --- scored windows -----------------------------------------------------------------
    "w": ((), f"""SELECT match_id, rn AS row_no, rn*0.5::DOUBLE AS time_s, floor(rn/40::DOUBLE)::BIGINT % 2 AS team,
        floor(q)/50::DOUBLE AS probability, CASE WHEN dc >= 0.08::DOUBLE THEN 1 ELSE 0 END AS label FROM (
        SELECT l_suppkey % 4 AS match_id, l_quantity AS q, l_discount AS dc, {_LINE} AS rn FROM lineitem)"""),
}
RECURSIVE = {"rec"}


def with_parts(sql: str) -> str:
    """``[a b] SELECT ...`` becomes the statement with parts a and b and all they need in front."""
    if not sql.startswith("["):
        return sql
    head, body = sql[1:].split("]", 1)
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in PARTS[name][0]:
            need(other)
        order.append(name)

    for name in head.split():
        need(name)
    ctes = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    recursive = "RECURSIVE " if RECURSIVE & set(order) else ""
    # the body may add its own parts after "AND"
    body = body.strip()
    if body.startswith("AND RECURSIVE_ "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.startswith("AND "):
        return f"WITH {recursive}{ctes},\n{body[4:]}"
    return f"WITH {recursive}{ctes}\n{body}"
