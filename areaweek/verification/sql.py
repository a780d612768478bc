"""Named table expressions from which the checking queries are composed."""

from __future__ import annotations

import re

from .. import fixtures as fx

PARTS: dict[str, str] = {
    "weeks": f"""select row_number() over (order by d) - 1 as week_index, cast(d as date) as week_start
        from (select unnest(generate_series(date '{fx.WEEKS.first}', date '{fx.WEEKS.last}', interval 7 day)) as d)""",
    "registry": f"select {fx.REGISTRY_SQL} from nation join region on n_regionkey = r_regionkey",
    "adjacency": """select concat('U', lpad(cast(n_nationkey as string), 3, '0')) as lga_code,
        concat('U', lpad(cast((n_nationkey + s) % 25 as string), 3, '0')) as neighbour_code, w as weight
        from nation cross join (values (5, 0.75::double), (20, 0.25::double)) t(s, w)""",
    "incidents": "select "
    + fx.INCIDENT_SQL.format(event_class=fx.SMALL_CLASS_SQL, lga_code=fx.SMALL_CODE_SQL)
    + " from orders join customer on o_custkey = c_custkey",
    "registry_l": f"select {fx.LARGE_REGISTRY_SQL} from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "incidents_l": "select "
    + fx.INCIDENT_SQL.format(event_class=fx.LARGE_CLASS_SQL, lga_code=fx.LARGE_CODE_SQL)
    + " from orders join customer on o_custkey = c_custkey",
    "docs": """select concat('D', cast(doc_id as string)) as doc_id, source,
        date '1995-01-02' + cast(doc_id % 2400 as integer) as published_at,
        list_distinct([concat('U', lpad(cast(doc_id % 25 as string), 3, '0')), concat('U', lpad(cast((doc_id * 7) % 25 as string), 3, '0'))]) as lga_codes,
        case when doc_id % 3 = 0 then cast(n_chars * 10 as double) end as ransom_ngn from documents""",
    "chatter": """select cast(event_id as string) as chatter_id, event_type as platform, ts as posted_at,
        concat('U', lpad(cast(user_id % 25 as string), 3, '0')) as lga_code, value / (1 + abs(value)) as threat_score from events""",
    "sentences": f"select {fx.SENTENCE_SQL} from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "grid": "select lga_code, state_name, area_sqkm, week_index, week_start from registry cross join weeks",
    "weekly": """select lga_code, cast(date_trunc('week', event_date) as date) as week_start,
        count(*) filter (event_class = 'banditry_kidnapping') as events,
        coalesce(sum(fatalities) filter (event_class = 'banditry_kidnapping'), 0) as fatalities,
        count(*) filter (event_class = 'state_operation') as operations
        from incidents group by all""",
    "weekly_actors": """select lga_code, cast(date_trunc('week', event_date) as date) as week_start,
        count(distinct coalesce(actor_secondary, actor_primary, 'unknown')) as actors
        from incidents where event_class = 'banditry_kidnapping' group by all""",
    "weekly_docs": """select lga_code, week_start, count(*) as mentions, count(*) filter (ransom_ngn > 0) as ransoms
        from (select unnest(lga_codes) as lga_code, cast(date_trunc('week', published_at) as date) as week_start, ransom_ngn from docs) group by all""",
    "own": """select g.*, cast(coalesce(w.events, 0) as double) as events, cast(coalesce(w.fatalities, 0) as double) as fatalities,
        cast(coalesce(w.operations, 0) as double) as operations, cast(coalesce(a.actors, 0) as double) as actors,
        cast(coalesce(d.mentions, 0) as double) as mentions, cast(coalesce(d.ransoms, 0) as double) as ransoms
        from grid g left join weekly w using (lga_code, week_start) left join weekly_actors a using (lga_code, week_start)
        left join weekly_docs d using (lga_code, week_start)""",
    "around": """select e.lga_code, o.week_index, sum(o.events * weight) as nb_events, sum(o.fatalities * weight) as nb_fatalities,
        sum(o.operations * weight) as nb_operations, sum(o.actors * weight) as nb_actors
        from adjacency e join own o on o.lga_code = e.neighbour_code group by all""",
    "state_totals": "select state_name, week_index, sum(events) as s_events, sum(operations) as s_operations from own group by all",
    "dense": """select o.*, coalesce(nb_events, 0) as nb_events, coalesce(nb_fatalities, 0) as nb_fatalities,
        coalesce(nb_operations, 0) as nb_operations, coalesce(nb_actors, 0) as nb_actors, s_events, s_operations
        from own o left join around using (lga_code, week_index) left join state_totals using (state_name, week_index)""",
}


def lag(measure: str, n: int) -> str:
    return (
        f"coalesce(sum({measure}) over (partition by lga_code order by week_index "
        f"rows between {n} preceding and 1 preceding), 0)"
    )


def since(measure: str, ceiling: int = 260) -> str:
    return (
        f"cast(coalesce(least(week_index - max(case when {measure} > 0 then week_index end) over (partition by lga_code order by week_index "
        f"rows between unbounded preceding and 1 preceding), {ceiling}), {ceiling}) as double)"
    )


def compose(body: str, parts: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every named expression it needs, in dependency order."""
    known = {**PARTS, **(parts or {})}
    ordered: list[str] = []

    def visit(sql: str, path: tuple[str, ...] = ()) -> None:
        for name in known:
            if name in path or name in ordered:
                continue
            if re.search(rf"\b(from|join|,)\s+{name}\b", sql, re.IGNORECASE):
                visit(known[name], (*path, name))
                ordered.append(name)

    visit(body)
    if not ordered:
        return body
    head = "with " + ",\n".join(f"{n} as ({known[n]})" for n in ordered)
    own_with = body.lstrip().lower().startswith("with ")
    return head + (",\n" + body.lstrip()[5:] if own_with else "\n" + body)
