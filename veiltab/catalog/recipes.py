"""Release recipes on the person view; cell-level recipes also as staged SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.registry import query
from veiltab.plans.recipes import BODY, COUNTS, RECIPES, run_recipe
from veiltab.plans.views import PERSON_SQL, gauss_sql, int_sql, person, u_sql, with_sql
from veiltab.session import materialize


def shown(df):
    """Numbers as doubles at two decimals so that types match across engines."""
    exprs = [F.round(F.col(c).cast("double"), 3).alias(c) if c in ("AGE", *COUNTS, *BODY) else F.col(c) for c in df.columns]
    return df.select(*exprs)


def register(name: str, sql: str | None = None):
    @query(f"recipe_{name}", sql)
    def _(spark, sf):
        return shown(run_recipe(materialize(person(spark, sf)), name))


# ---------------------------------------------------------------- staged SQL of the cell-level steps

def _n(c):
    return f"CAST({c} AS DOUBLE)"


def _mm(c, t, f):
    return f"(SELECT {f}({c}) FROM {t})"


def _clip(x, lo, hi):
    return f"least(greatest({x},{lo}),{hi})"


def _top(t, order, n, where="true"):
    return (f"(SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {order}, row_id) AS rn FROM {t} "
            f"WHERE {where}) z WHERE rn<={n})")


def replace_uniform(t, s, c, p):
    return (f"CASE WHEN {c} IS NOT NULL AND {u_sql(f'{s}{c}/p')}<{p} THEN (SELECT list_filter(l, lambda x: x<>{t}.{c})"
            f"[1+floor({u_sql(f'{s}{c}/v', t + '.row_id')}*(len(l)-1))::INT] FROM (SELECT list_sort(list(DISTINCT {c})) AS l FROM {t}) q) ELSE {c} END")


def replace_weighted(t, s, c, p):
    cum = f"(SELECT {c} AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY {c})-count(*) AS pre FROM {t} GROUP BY 1)"
    own = f"(SELECT {{}} FROM {cum} o WHERE o.v={t}.{c})"
    t0 = f"floor({u_sql(f'{s}{c}/v', t + '.row_id')}*((SELECT count(*) FROM {t})-{own.format('n')}))"
    pos = f"({t0}+CASE WHEN {t0}>={own.format('pre')} THEN {own.format('n')} ELSE 0 END)"
    return (f"CASE WHEN {u_sql(f'{s}{c}/p')}<{p} THEN (SELECT v FROM {cum} k WHERE {pos}>=k.pre AND {pos}<k.pre+k.n) ELSE {c} END")


def replace_fixed(t, s, c, moves):
    out = c
    for a, b, p in moves:
        out = f"CASE WHEN {c}='{a}' AND {u_sql(f'{s}{c}/move')}<{p} THEN '{b}' ELSE {out} END"
    return out


def group_named(t, s, c, listed, label):
    return f"CASE WHEN {c} IN ({','.join(repr(x) for x in listed)}) THEN '{label}' ELSE {c} END"


def noise_age(t, s, c, delta):
    return f"CASE WHEN {c} IS NOT NULL THEN {_clip(f'round_even({_n(c)},0)+{int_sql(-delta, delta, f'{s}{c}/d')}', 2, 110)} END"


def noise_age_segments(t, s, c, segments):
    cases = " ".join(f"WHEN {c}<={b} THEN floor({u_sql(f'{s}{c}/d')}*{2 * d + 1})-{d}" for b, d in segments)
    return _clip(f"{c}+CASE {cases} END", 2, 110)


def _holes(t, s, c, x):
    n = f"(SELECT count(*)-count({c}) FROM {t})"
    return f"CASE WHEN row_id NOT IN {_top(t, u_sql(f'{s}{c}/hole'), n)} THEN {x} END"


def noise_int(t, s, c, lo, hi, blanks="replace", upper=True):
    mn, mx = f"floor({_mm(c, t, 'min')})", f"ceil({_mm(c, t, 'max')})"
    x = f"{c}+{int_sql(lo, hi, f'{s}{c}/d')}"
    x = _clip(x, mn, mx) if upper else f"greatest({x},{mn})"
    if blanks == "keep":
        return f"CASE WHEN {c} IS NOT NULL THEN round_even({x},0) END"
    fill = f"{mn}+floor({u_sql(f'{s}{c}/fill')}*({mx}-{mn}+1))"
    return _holes(t, s, c, f"CASE WHEN {c} IS NOT NULL THEN round_even({x},0) ELSE {fill} END")


def noise_int_positive(t, s, c, lo, hi):
    return f"CASE WHEN {c}>=1 THEN greatest({c}+{int_sql(lo, hi, f'{s}{c}/d')},1) ELSE {c} END"


def noise_float(t, s, c, lo, hi, blanks="keep"):
    mn, mx = _mm(c, t, "min"), _mm(c, t, "max")
    x = f"round({_clip(f'{c}+({lo}+{u_sql(f'{s}{c}/d')}*{hi - lo})', mn, mx)},2)"
    if blanks == "keep":
        return f"CASE WHEN {c} IS NOT NULL THEN {x} END"
    return _holes(t, s, c, f"CASE WHEN {c} IS NOT NULL THEN {x} ELSE round({mn}+{u_sql(f'{s}{c}/fill')}*({mx}-{mn}),2) END")


def noise_proportional(t, s, c, sigma, digits=2):
    x = _clip(f"{c}*(1+{gauss_sql(f'{s}{c}/g')}*{sigma})", _mm(c, t, "min"), _mm(c, t, "max"))
    return f"CASE WHEN {c} IS NOT NULL THEN {'round_even' if digits is None else 'round'}({x},{digits or 0}) END"


def noise_sparse(t, s, c, share, choices, lo, hi, weights=None, integer=True):
    u = u_sql(f"{s}{c}/v")
    if weights:
        acc, cases = 0.0, []
        for v, w in list(zip(choices, weights))[:-1]:
            acc += w / sum(weights)
            cases.append(f"WHEN {u}<{acc!r} THEN {v}")
        pick = f"CASE {' '.join(cases)} ELSE {choices[-1]} END"
    else:
        pick = f"CASE floor({u}*{len(choices)})::INT " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(choices)) + " END"
    x = f"CASE WHEN {c} IS NOT NULL AND {u_sql(f'{s}{c}/p')}<{share} THEN {_clip(f'{_n(c)}+({pick})', lo, hi)} ELSE {_n(c)} END"
    return f"trunc({x})" if integer else f"round({x},2)"


def flip(t, s, c, p, where="true"):
    return f"CASE WHEN {u_sql(f'{s}{c}/flip')}<{p} AND coalesce({where},false) THEN 1-{c} ELSE {c} END"


def flip_cohort_random(t, s, c, value, share, cohort):
    return f"CASE WHEN coalesce({cohort},false) AND {u_sql(f'{s}{c}/cohort{value}')}<{share} THEN {value} ELSE {c} END"


def raise_share(t, s, c, target, tiers):
    tier = "CASE " + " ".join(f"WHEN {w} THEN {i}" for i, w in enumerate(tiers)) + f" ELSE {len(tiers)} END" if tiers else "0"
    n = f"(SELECT floor(count(*)*{target})-sum({c}) FROM {t})"
    return f"CASE WHEN row_id IN {_top(t, f'{tier}+{u_sql(f'{s}{c}/raise')}', n, f'{c}=0')} THEN 1 ELSE {c} END"


def match_share(t, s, c, level, other, target):
    gap = f"(SELECT trunc(count(*)*{target})-count(CASE WHEN {c}='{level}' THEN 1 END) FROM {t})"
    u = u_sql(f"{s}{c}/share")
    return (f"CASE WHEN {gap}>0 AND row_id IN {_top(t, u, gap, f'{c}={other!r}')} THEN '{level}' "
            f"WHEN {gap}<0 AND row_id IN {_top(t, u, '-' + gap, f'{c}={level!r}')} THEN '{other}' ELSE {c} END")


def format_sql(t, s, integers, decimals):
    out = {}
    for c in [*integers, *decimals]:
        x = f"coalesce({_n(c)},{_mm(c, t, 'median')})"
        x = _clip(x, 2, 110) if c == "AGE" else x
        out[c] = f"round_even({x},{decimals.get(c, 0)})"
    return out


SQL_STEPS = {f.__name__: f for f in (replace_uniform, replace_weighted, replace_fixed, group_named, noise_age, noise_age_segments,
                                     noise_int, noise_int_positive, noise_float, noise_proportional, noise_sparse, flip,
                                     flip_cohort_random, raise_share, match_share)}


def recipe_sql(name: str) -> str | None:
    """One materialised stage per step, or None when a step exchanges values between rows."""
    if any(op not in SQL_STEPS and op != "format" for op, _ in RECIPES[name]):
        return None
    ctes, t = [PERSON_SQL.replace("person AS (", "person AS MATERIALIZED (")], "person"
    for i, (op, args) in enumerate(RECIPES[name]):
        s = f"{name}{i}/"
        new = format_sql(t, s, **args) if op == "format" else {args["c"]: SQL_STEPS[op](t, s, **args)}
        ctes.append(f"s{i} AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in new.items())}) FROM {t})")
        t = f"s{i}"
    nums = ", ".join(f"round({_n(c)},3) AS {c}" for c in ("AGE", *COUNTS, *BODY))
    return with_sql(f"SELECT * REPLACE ({nums}) FROM {t}", *ctes)


def row_shuffle_sql() -> str:
    nums = ", ".join(f"round({_n(c)},3) AS {c}" for c in ("AGE", *COUNTS, *BODY))
    new_id = f"row_number() OVER (ORDER BY {u_sql('row_shuffle0/shuffle')}, row_id)"
    return with_sql(f"SELECT * REPLACE ({new_id} AS row_id, {nums}) FROM person", PERSON_SQL)


def group_shuffle_sql() -> str:
    (_, args), = RECIPES["group_shuffle"]
    band = "floor(AGE/5)::INT"

    def places(salt, *cols):
        rn = f"row_number() OVER (PARTITION BY {band} ORDER BY {u_sql('group_shuffle0/perm/' + salt)}, row_id)"
        return f"(SELECT {', '.join(cols)}, {band} AS band, {rn} AS rn FROM person WHERE AGE<120)"

    cols = ", ".join(f"round({_n(f't{i}.{c}')},3) AS {c}" if c in (*COUNTS, *BODY) else f"t{i}.{c}"
                     for i, c in enumerate(args["cols"]))
    joins = "\n".join(f"JOIN {places(c, c)} t{i} ON t{i}.band=p.band AND t{i}.rn=p.rn" for i, c in enumerate(args["cols"]))
    return with_sql(f"SELECT p.row_id, round({_n('p.AGE')},3) AS AGE, {cols} FROM {places('base', 'row_id', 'AGE')} p\n{joins}",
                    PERSON_SQL.replace("person AS (", "person AS MATERIALIZED ("))


EXCHANGED = {"row_shuffle": row_shuffle_sql, "group_shuffle": group_shuffle_sql}
for _name in RECIPES:
    register(_name, EXCHANGED[_name]() if _name in EXCHANGED else recipe_sql(_name))
