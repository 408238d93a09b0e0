"""Query of legends, with SQL; registered beside those of linework.plans.registry.

Customers are lines, two to a block and sixty to a legend; a block's trains are those of its even line, its map's boxes lie around the sites.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linework.operators import legend as G
from linework.plans.registry import _ADVANCES, query
from linework.sources import adapters as A

LEGEND_SQL = f"""a(c, w) as (values {_ADVANCES}), g as ({A.GROUPS_SQL}), b as (select line_id // 60 as lg, line_id // 2 as block, line_id % 2 as pos, line_id from g where line_id % 11 <> 5 or line_id % 2 = 0),
    r as (select line_id // 60 as lg, line_id // 2 as block, unnest(range(n)) as row, grp as kind, grp || ' <> ' || line_id as route, line_id, n from g where line_id % 2 = 0),
    t as (select lg, block, row, kind, route, row + 1 as cars, row % 2 as hollow, case when line_id % 7 = 0 and row = 0 then 'N' || line_id end as note, 2 as nc from r),
    tx as (select distinct unnest([kind, route, 'Linie', 'Zuggruppe', 'Laufweg', 'Zugstärke', ' *']) as s from t), ch as (select s, unnest(string_split(s, '')) as c from tx), w as (select s, sum(coalesce(w, 0.62::double)) * 10 as w from ch left join a on a.c = ch.c group by s),
    bw as (select *, case when length(line_id::varchar) > 1 then left(line_id::varchar, 1) || ' ' || substr(line_id::varchar, 2) else line_id::varchar end as txt from b), bw2 as (select *, length(txt) * 6::double + 6 as w from bw),
    w0 as (select lg, greatest(max(w), (select w from w where s = 'Linie')) + 10 as w0 from bw2 group by lg),
    w13 as (select lg, greatest(max(k.w), (select w from w where s = 'Zuggruppe')) + 10 as w1, greatest(max(r.w), (select w from w where s = 'Laufweg')) + 10 as w2, greatest(65.5::double + case when bool_or(note is not null) then (select w from w where s = ' *') else 0 end, (select w from w where s = 'Zugstärke')) + 10 as w3 from t join w k on k.s = kind join w r on r.s = route group by lg),
    wd as (select w0.lg, w0, coalesce(w1, (select w from w where s = 'Zuggruppe') + 10) as w1, coalesce(w2, (select w from w where s = 'Laufweg') + 10) as w2, coalesce(w3, greatest(65.5::double, (select w from w where s = 'Zugstärke')) + 10) as w3 from w0 left join w13 on w13.lg = w0.lg),
    n as (select lg, block, count(*) as lines from b group by lg, block), tn as (select lg, block, count(*) as rows, count(note) as notes from t group by lg, block),
    bh as (select n.lg, n.block, lines, coalesce(rows, 0) as rows, coalesce(notes, 0) as notes, case when coalesce(rows, 0) <= 1 then 18 else 14 end as pitch from n left join tn on tn.lg = n.lg and tn.block = n.block),
    bl as (select *, greatest(18 + greatest(rows - 1, 0) * pitch, lines * 18) as height from bh), bo as (select *, coalesce(sum(height) over (partition by lg order by block rows between unbounded preceding and 1 preceding), 0) as off from bl),
    hi as (select lg, sum(height) as tab, sum(notes) as notes from bl group by lg), p as (select wd.*, (lg * 10)::double as x0, lg * 10 + w0 + w1 + w2 + w3 as x1, 18 + tab + notes * 18 as h, tab from wd join hi using (lg)),
    ink as (select id // 60 as lg, x, y from ({A.SITES_SQL})), tp as (select p.lg, min(y) as top from p join ink on ink.lg = p.lg where x < x1 and x + 9 > x0 group by p.lg),
    bx as (select p.*, case when p.lg % 3 = 0 then 7::double else coalesce(top - 36 - h, 0) end as y0 from p left join tp on tp.lg = p.lg),
    o as (select bo.*, bx.* exclude (lg), y0 + 18 + off as ytop, y0 + 18 + tab as bottom from bo join bx on bx.lg = bo.lg),
    q as (select t.*, o.* exclude (lg, block, rows), o.rows, ytop + (height - rows * pitch) / 2 + (row + 0.5::double) * pitch as mid from t join o on o.lg = t.lg and o.block = t.block),
    nt as (select *, bottom + (row_number() over (partition by lg order by block, row) - 1) * 18 as ntop from q where note is not null),
    br as (select bw2.*, o.* exclude (lg, block), row_number() over (partition by bw2.lg, bw2.block order by pos, line_id) - 1 as nth from bw2 join o on o.lg = bw2.lg and o.block = bw2.block),
    e as (select lg, 'head' as kind, 0 as block, unnest([0, 1, 2, 3]) as place, unnest([x0 + 5, x0 + w0 + 5, x0 + w0 + w1 + 5, x0 + w0 + w1 + w2 + 5]) as x, y0 + 12.96::double as y, null::double as x1, null::double as y1, unnest(['Linie', 'Zuggruppe', 'Laufweg', 'Zugstärke']) as text from bx
        union all select lg, 'rule', 0, 0, x0, y0 + 18, x1, y0 + 18, null from bx
        union all select lg, 'column', 0, unnest([1, 2, 3]), unnest([x0 + w0, x0 + w0 + w1, x0 + w0 + w1 + w2]), y0, unnest([x0 + w0, x0 + w0 + w1, x0 + w0 + w1 + w2]), y0 + 18 + tab, null from bx
        union all select lg, 'rule', block, 1, x0, ytop + height, x1, ytop + height, null from o
        union all select lg, 'badge', block, nth, x0 + 5, ytop + (height - lines * 17 + 2) / 2 + nth * 17, x0 + 5 + w, ytop + (height - lines * 17 + 2) / 2 + nth * 17 + 15, txt from br
        union all select lg, 'train', block, row, x0 + w0 + 5, mid + 3.5::double, null, null, kind from q union all select lg, 'route', block, row, x0 + w0 + w1 + 5, mid + 3.5::double, null, null, route from q
        union all select lg, 'star', block, row, x0 + w0 + w1 + w2 + 5 + cars * 16.5::double + 2, mid + 3.5::double, null, null, '*' from nt
        union all select lg, 'note', block, row, x0 + w0 + 5, ntop + 12.96::double, null, null, '* ' || note from nt
        union all select lg, 'car', block, row * 10 + k, x0 + w0 + w1 + w2 + 5 + k * 16.5::double, mid - 2.5::double, x0 + w0 + w1 + w2 + 21 + k * 16.5::double, mid + 2.5::double, case when k < cars - hollow then 'full' else 'hollow' end from (select *, unnest(range(cars)) as k from q)
        union all select lg, 'note car', block, row * 10 + k, x0 + w0 + w1 + w2 + 5 + k * 16.5::double, ntop + 6.5::double, x0 + w0 + w1 + w2 + 21 + k * 16.5::double, ntop + 11.5::double, 'full' from (select *, unnest(range(nc)) as k from nt))"""


@query(f"with {LEGEND_SQL} select lg as legend_id, kind, block::bigint as block, place::bigint as place, round(x, 4) + 0 as x, round(y, 4) + 0 as y, round(x1, 4) + 0 as x1, round(y1, 4) + 0 as y1, text from e")
def legend_elements(spark, sf_dir):
    """Every element of the legends; two in three hang above what the map has in their column."""
    g = A.groups(spark, sf_dir).withColumn("legend_id", F.floor(F.col("line_id") / 60)).withColumn("block", F.floor(F.col("line_id") / 2))
    i = F.col("line_id")
    badges = g.where("line_id % 11 <> 5 or line_id % 2 = 0").select("legend_id", "block", (i % 2).alias("badge_pos"), "line_id")
    rows = g.where("line_id % 2 = 0").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    k = F.col("row")
    note = F.when((i % 7 == 0) & (k == 0), F.concat(F.lit("N"), i.cast("string")))
    trains = rows.select("legend_id", "block", "row", F.col("grp").alias("kind"), F.concat("grp", F.lit(" <> "), i.cast("string")).alias("route"), (k + 1).alias("cars"), (k % 2).alias("hollow"), note.alias("note"), F.lit(2).alias("note_cars"))
    lg = F.col("legend_id")
    places = badges.select("legend_id").distinct().select("legend_id", (lg * 10).cast("double").alias("x"), F.when(lg % 3 == 0, 7.0).alias("y"))
    ink = A.sites(spark, sf_dir).select(F.floor(F.col("id") / 60).alias("legend_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 9).alias("x1"), (F.col("y") + 9).alias("y1"))
    blocks = G.blocks(badges, trains)
    found = G.elements(badges, trains, blocks, G.boxes(places, G.widths(badges, trains), blocks, ink))
    return found.select("legend_id", "kind", "block", "place", *[(F.round(c, 4) + 0).alias(c) for c in ("x", "y", "x1", "y1")], "text")
