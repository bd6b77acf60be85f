"""The engine's operators as queries over the supplied tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import decode, evaluate, lookup, metrics, network, signal, tiers

STOPS = ["the", "and", "of", "de", "la", "der", "die"]
CLIP = 50
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- labels and vocabulary

TOKENS = "(select conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as symbol, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) as pos from conversations)"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.labels_in(F.col("text"))).alias("p", "symbol")).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos"), "symbol")


@query(f"select conv_id, turn, row_number() over (partition by conv_id, turn order by pos) as pos, symbol from {TOKENS} where symbol not in ({', '.join(repr(s) for s in STOPS)})")
def phone_tokenize(spark, sf):
    kept = tokens(spark, sf).filter(~F.col("symbol").isin(STOPS))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")).cast("long"))


VOCAB_SQL = """vocab as (select lang || '/' || w as symbol, count(*) as token_id from (select lang, unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) as w from documents) where w not in ('', 'a', 'de', 'in', 'is', 'le') group by 1
union all select w, count(*) from (select unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) as w from documents) where w in ('a', 'de', 'in', 'is', 'le', 'that', 'with') group by 1)"""


@query(f"with {VOCAB_SQL}, t as (select lower(t.symbol) as symbol, case c.role when 'user' then 'en' when 'assistant' then 'fr' else 'de' end as lang from {TOKENS} t join conversations c using (conv_id, turn)) select t.lang, t.symbol, coalesce(case when t.symbol in ('a', 'in') then l.token_id else coalesce(q.token_id, l.token_id) end, 0) as token_id, count(*) as n from t left join vocab q on q.symbol = t.lang || '/' || t.symbol left join vocab l on l.symbol = t.symbol group by all")
def vocab_resolve(spark, sf):
    w, shared = F.col("w"), ["a", "de", "in", "is", "le"]
    words = table(spark, sf, "documents").select("lang", F.explode(F.split(F.lower("text"), "[^a-zà-ÿ]+")).alias("w")).filter("w <> ''")
    words = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    literal = F.when(w.isin(*shared, "that", "with"), w)
    names = F.array_compact(F.array(F.when(~w.isin(shared), F.concat("lang", F.lit("/"), w)), literal))
    vocab = words.select(F.explode(names).alias("symbol"), "n").groupBy("symbol").agg(F.sum("n").alias("token_id"))
    role = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    lang = F.when(F.col("role") == "user", "en").when(F.col("role") == "assistant", "fr").otherwise("de")
    asked = tokens(spark, sf).join(role, ["conv_id", "turn"]).select(lang.alias("lang"), F.lower("symbol").alias("symbol")).groupBy("lang", "symbol").agg(F.count("*").alias("n"))
    return lookup.resolve(asked, vocab, ["a", "in"]).select("lang", "symbol", F.coalesce("token_id", F.lit(0)).alias("token_id"), "n")


@query("select doc_id, lang, source, case when starts_with(label, lang || '/') and length(label) > length(lang) + 1 then substr(label, length(lang) + 2) else label end as label from (select doc_id, lang, source, case when doc_id % 3 = 0 then lang || '/' || source when doc_id % 3 = 1 then source else lang || '/' end as label from documents)")
def lang_strip(spark, sf):
    label = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("/"), "source")).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(F.concat("lang", F.lit("/")))
    return table(spark, sf, "documents").select("doc_id", "lang", "source", X.strip_language(label, F.col("lang")).alias("label"))


@query("select lang, source, doc_id, n_chars from (select *, row_number() over (partition by lang, source order by doc_id) as r from documents) where r = 1")
def csv_first_match(spark, sf):
    return lookup.first_match(table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], "doc_id")


@query("select p_partkey, p_type, case when p_type like 'STANDARD%' then 'q8' when p_type like '%STEEL' then 'q4' when p_type like '%A%' then 'f16' end as rule from part")
def rule_match(spark, sf):
    return lookup.first_rule(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", [("STANDARD*", "q8"), ("*STEEL", "q4"), ("*A*", "f16")])


@query("select p_name as name, 'missing' as side from part where p_brand = 'Brand#4' and p_name not in (select p_name from part where p_brand = 'Brand#7') union select p_name, 'extra' from part where p_brand = 'Brand#7' and p_name not in (select p_name from part where p_brand = 'Brand#4')")
def name_audit(spark, sf):
    """Names that one brand needs and another lacks, and the other way round."""
    part = table(spark, sf, "part").select("p_brand", F.col("p_name").alias("name"))
    need, have = (part.filter(F.col("p_brand") == b).select("name").distinct() for b in ("Brand#4", "Brand#7"))
    return need.join(have, "name", "left_anti").withColumn("side", F.lit("missing")).unionByName(have.join(need, "name", "left_anti").withColumn("side", F.lit("extra")))


# ---- similarity and decode

SIM_SQL = f"""cent as (select label, list(m order by d) as c from (select label, d, avg(x) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings) group by all) group by label),
cells as (select vec_id // {CLIP} as clip_id, vec_id % {CLIP} as t, cent.label as n, round(list_cosine_similarity(embedding::double[], c) * 1024) / 1024 + 0.0::double as s from embeddings, cent)"""
UNIFORM_SQL = "spans as (select clip_id, n, n * f // k as on_f, (n + 1) * f // k as off_f from (select clip_id, max(t) + 1 as f from cells group by 1), (select unnest(range(k)) as n, k from (select max(label) + 1 as k from embeddings)))"


def similarities(spark: SparkSession, sf: str) -> DataFrame:
    """(clip_id, t, sims): each vector against the mean vector of each label, in steps of 2**-10."""
    e = table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("c"))
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "c"))), lambda x: x["c"]).alias("cents"))  # a row: labels x dimensions
    sims = F.transform("cents", lambda c: F.round(V.cosine(F.col("embedding"), c) * 1024) / 1024 + 0.0)
    return e.join(F.broadcast(means)).select(F.expr(f"vec_id div {CLIP}").alias("clip_id"), (F.col("vec_id") % CLIP).alias("t"), sims.alias("sims"))


def cells_of(sims: DataFrame) -> DataFrame:
    return sims.select("clip_id", "t", F.posexplode("sims").alias("n", "s"))


def uniform(sims: DataFrame) -> DataFrame:
    size = sims.groupBy("clip_id").agg((F.max("t") + 1).alias("f"), F.max(F.size("sims")).alias("k"))
    return size.select("clip_id", "f", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("n")).select("clip_id", "n", F.expr("n * f div k").alias("on_f"), F.expr("(n + 1) * f div k").alias("off_f"))


@query(f"with {SIM_SQL} select clip_id, t, n, s from cells")
def cosine_matrix(spark, sf):
    return cells_of(similarities(spark, sf))


#: The decoder's recurrence with the move taken at each boundary (0 wait, 1 leave a label, 2 skip) and the labels entered,
#: walked back from the last boundary; as all boundaries permit a gap, skipped labels lie where the next one starts.
DECODE_SQL = f"""with recursive {SIM_SQL}, rows as (select clip_id, t, list(s order by n) as s from cells group by all),
dp as (select clip_id, 0::bigint as t, list_transform(range(len(s) + 1), lambda i: -0.5::double * i) as g,
    list_transform(range(len(s)), lambda i: -1e9::double) as k, list_transform(range(len(s)), lambda i: false) as entered,
    list_transform(range(len(s) + 1), lambda i: case when i = 0 then 0 else 2 end) as move from rows where t = 0
  union all
  select clip_id, t, h, k, entered, list_transform(range(1, len(h) + 1), lambda i: case when h[i] > v[i] then 2 when i > 1 and k[greatest(i - 1, 1)] > g[i] then 1 else 0 end)
  from (select *, list_transform(range(1, len(v) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda j: v[j] + 0.5::double * (j - 1))) - 0.5::double * (i - 1)) as h
    from (select *, list_transform(range(1, len(g) + 1), lambda i: case when i = 1 then g[1] else greatest(g[i], k[greatest(i - 1, 1)]) end) as v
      from (select dp.clip_id, dp.t + 1 as t, dp.g, list_transform(range(1, len(dp.k) + 1), lambda i: dp.g[i] > dp.k[i]) as entered,
          list_transform(range(1, len(dp.k) + 1), lambda i: greatest(dp.k[i], dp.g[i]) + s[i]) as k
        from dp join rows on rows.clip_id = dp.clip_id and rows.t = dp.t)))),
back as (select clip_id, max(t) as t, max(len(g)) - 1 as i, false as inside, 0::bigint as off_f, null::bigint as n, null::bigint as a, null::bigint as b from dp group by 1
  union all
  select clip_id, case when inside or how = 0 then t - 1 else t end, case when (inside and came) or (not inside and how = 2) then i - 1 else i end,
    case when inside then not came else how = 1 end, case when inside then off_f else t end,
    case when (inside and came) or (not inside and how = 2) then i - 1 end, case when inside then t - 1 else t end, case when inside then off_f else t end
  from (select back.clip_id, back.t, back.i, back.inside, back.off_f, dp.move[back.i + 1] as how, dp.entered[back.i] as came
    from back join dp on dp.clip_id = back.clip_id and dp.t = back.t where back.i > 0)),
decoded as (select clip_id, n, a, b, (select max(t) + 1 from cells c where c.clip_id = back.clip_id) as frames from back where n is not null),
spans as (select clip_id, n, case when a < b then a else coalesce(p, frames) end as on_f, case when a < b then b else coalesce(p, frames) end as off_f, frames
  from (select *, first_value(case when a < b then a end ignore nulls) over (partition by clip_id order by n rows between 1 following and unbounded following) as p from decoded))"""


@query(f"{DECODE_SQL} select clip_id, cast(n as integer) as n, cast(on_f as integer) as on_f, cast(off_f as integer) as off_f from spans")
def span_decode(spark, sf):
    return decode.decode_clips(similarities(spark, sf)).drop("score")


@query(f"""with recursive {SIM_SQL}, rows as (select clip_id, t, list(s order by n) as s from cells group by all),
dp as (select clip_id, 0::bigint as t, list_transform(range(len(s) + 1), lambda i: -0.5::double * i) as g, list_transform(range(len(s)), lambda i: -1e9::double) as k from rows where t = 0
union all select clip_id, t, list_transform(range(1, len(v) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda j: v[j] + 0.5::double * (j - 1))) - 0.5::double * (i - 1)), k from (
select clip_id, t, k, list_transform(range(1, len(g) + 1), lambda i: case when i = 1 then g[1] else greatest(g[i], k[i - 1]) end) as v from (
select dp.clip_id, dp.t + 1 as t, dp.g, list_transform(range(1, len(dp.k) + 1), lambda i: greatest(dp.k[i], dp.g[i]) + s[i]) as k from dp join rows on rows.clip_id = dp.clip_id and rows.t = dp.t)))
select clip_id, cast(g[len(g)] as double) as score from dp qualify row_number() over (partition by clip_id order by t desc) = 1""")
def decode_score(spark, sf):
    """The score from the spans themselves: similarity inside them less 0.5 for each skipped label."""
    sims = similarities(spark, sf)
    spans = decode.decode_clips(sims)
    inside = spans.join(cells_of(sims), ["clip_id", "n"]).filter("t >= on_f and t < off_f").groupBy("clip_id").agg(F.sum("s").alias("gain"))
    skips = spans.groupBy("clip_id").agg(F.sum(F.when(F.col("on_f") >= F.col("off_f"), 0.5).otherwise(0.0)).alias("loss"))
    return skips.join(inside, "clip_id", "left").select("clip_id", (F.coalesce("gain", F.lit(0.0)) - F.col("loss")).alias("score"))


@query(f"with {SIM_SQL}, {UNIFORM_SQL} select clip_id, round(avg(coalesce(m, 0)), 8) as confidence from (select s.clip_id, s.n, avg(c.s) as m from spans s left join cells c on c.clip_id = s.clip_id and c.n = s.n and c.t >= on_f and c.t < off_f group by all) group by 1")
def confidence(spark, sf):
    sims = similarities(spark, sf)
    return metrics.confidence(cells_of(sims), uniform(sims)).select("clip_id", F.round("confidence", 8).alias("confidence"))


@query(f"""with {SIM_SQL}, {UNIFORM_SQL}, a as (select *, pow(greatest(s, 0), 2) as a from cells), l as (select *, sum(a) over (partition by clip_id, t order by n range between 5 preceding and 5 following) as loc from a)
select clip_id, round(sum(a) / (sum(loc) + 1e-8), 8) as determinacy from l join spans using (clip_id, n) where t >= on_f and t < off_f group by 1""")
def determinacy(spark, sf):
    sims = similarities(spark, sf)
    return metrics.determinacy(cells_of(sims), uniform(sims)).select("clip_id", F.round("determinacy", 8).alias("determinacy"))


@query(f"""with {SIM_SQL}, {UNIFORM_SQL}, a as (select *, pow(greatest(s, 0), 2) as a from cells), l as (select *, sum(a) over (partition by clip_id, t order by n rows between current row and unbounded following) as later, sum(a) over (partition by clip_id, t) as al from a)
select clip_id, round(avg(later / al), 8) as monotonicity from l join spans using (clip_id, n) where t >= on_f and t < off_f and al > 0 group by 1""")
def monotonicity(spark, sf):
    sims = similarities(spark, sf)
    return metrics.monotonicity(cells_of(sims), uniform(sims)).select("clip_id", F.round("monotonicity", 8).alias("monotonicity"))


@query(f"with {SIM_SQL}, r as (select clip_id, t, list(s order by n) as l from cells group by all) select clip_id, round(avg(exp(l[t % 10 + 1] - list_max(l)) / list_sum(list_transform(l, lambda x: exp(x - list_max(l))))), 8) as agreement from r group by 1")
def agreement(spark, sf):
    return similarities(spark, sf).groupBy("clip_id").agg(F.round(F.avg(V.softmax_at(F.col("sims"), (F.col("t") % 10).cast("int"))), 8).alias("agreement"))


CELLS_SQL = f"select vec_id, vec_id // {CLIP} as c, vec_id % {CLIP} as t, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as d from embeddings"


def layer(spark: SparkSession, sf: str, f: Callable) -> DataFrame:
    """(vec_id, d, y): a network layer over the vectors of each clip as a matrix [frame, dimension]."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("vec_id")
        y = f(np.array(pdf.embedding.tolist(), float))
        return pd.DataFrame({"vec_id": np.repeat(pdf.vec_id.to_numpy(), y.shape[1]), "d": np.tile(np.arange(y.shape[1]), len(y)), "y": y.ravel()})

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.expr(f"vec_id div {CLIP}").alias("c"))
    return rows.groupBy("c").applyInPandas(run, "vec_id long, d long, y double").withColumn("y", F.round("y", 6) + 0.0)


@query(f"select vec_id, d, round(x / sqrt(avg(x * x) over (partition by vec_id) + 1e-6), 6) + 0.0::double as y from ({CELLS_SQL})")
def rms_norm(spark, sf):
    return layer(spark, sf, lambda x: network.rms_norm(x, 1.0))


@query(f"select vec_id, o as d, round(sum(x * ((o + 1) * d % 7 - 3)) + 0.5, 6) + 0.0::double as y from ({CELLS_SQL}), (select unnest(range(8)) as o) group by vec_id, o")
def linear(spark, sf):
    import numpy as np

    weights = np.array([[(o + 1) * d % 7 - 3 for d in range(64)] for o in range(8)], float)
    return layer(spark, sf, lambda x: network.linear(x, weights, np.full(8, 0.5)))


@query(f"select vec_id, d, round(0.25 * coalesce(lag(x) over w, 0) + 0.5 * x + 0.25 * coalesce(lead(x) over w, 0), 6) + 0.0::double as y from ({CELLS_SQL}) window w as (partition by c, d order by t)")
def dwconv(spark, sf):
    import numpy as np

    return layer(spark, sf, lambda x: network.depthwise(x, np.tile([0.25, 0.5, 0.25], (64, 1))))


@query(f"""with a as (select *, t * pow(10000, -(d // 2) / 32.0) as angle, case when d % 2 = 0 then lead(x) over w else lag(x) over w end as other from ({CELLS_SQL}) window w as (partition by vec_id order by d))
select vec_id, d, round(x * cos(angle) + case when d % 2 = 0 then -other else other end * sin(angle), 6) + 0.0::double as y from a""")
def rope(spark, sf):
    return layer(spark, sf, lambda x: network.rope(x[:, None], 1e4)[:, 0])


# ---- intervals

SPANS_SQL = "sp as (select user_id, event_id as n, event_type as text, on_ms, on_ms + cast(round(value * 20000) as bigint) as off_ms from (select *, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000 as on_ms from events)), num as (select *, row_number() over (partition by user_id order by on_ms, n) as ord from sp), "
CLAMP_SQL = SPANS_SQL + "c1 as (select *, max(greatest(off_ms, on_ms + 1) - ord) over (partition by user_id order by ord) + ord as off2 from num), cl as (select user_id, ord, n, text, greatest(on_ms, coalesce(lag(off2) over (partition by user_id order by ord), on_ms)) as on_ms, off2 as off_ms from c1)"


def raw_spans(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("on_ms", X.since_2024_ms(F.col("ts")))
    e = e.select("user_id", F.col("event_id").alias("n"), F.col("event_type").alias("text"), "on_ms", (F.col("on_ms") + F.round(F.col("value") * 20000).cast("long")).alias("off_ms"))
    return e.withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("on_ms", "n")).cast("long"))


def clamped(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.clamp(raw_spans(spark, sf), "user_id", "ord").select("user_id", "ord", "n", "text", "on_ms", "off_ms")


@query(f"with {CLAMP_SQL} select * from cl")
def monotone_clamp(spark, sf):
    return clamped(spark, sf)


@query(f"with {CLAMP_SQL}, s as (select *, case when lag(text) over (partition by user_id order by ord) is not distinct from text then 0 else 1 end as st from cl), r as (select *, sum(st) over (partition by user_id order by ord) as run from s) select user_id, cast(run as bigint) as run, any_value(text) as text, min(on_ms) as on_ms, max(off_ms) as off_ms, count(*) as n from r group by user_id, run")
def tier_islands(spark, sf):
    return tiers.runs(clamped(spark, sf), "user_id", "ord", "text")


FILL_SQL = CLAMP_SQL + ", en as (select user_id, max(off_ms) + 1000 as end_ms from cl group by 1), m as (select user_id, on_ms, off_ms, text from cl union all select user_id, end_ms, null, null from en), p as (select *, coalesce(max(off_ms) over (partition by user_id order by off_ms is null, on_ms, off_ms rows between unbounded preceding and 1 preceding), 0) as pv from m), filled as (select user_id, on_ms, off_ms, text from p where off_ms is not null union all select user_id, pv, on_ms, 'SP' from p where pv < on_ms)"


def filled(spark: SparkSession, sf: str) -> DataFrame:
    spans = clamped(spark, sf)
    return tiers.fill_gaps(spans, "user_id", spans.groupBy("user_id").agg((F.max("off_ms") + 1000).alias("end_ms")), "SP")


@query(f"with {FILL_SQL} select * from filled")
def gap_fill(spark, sf):
    return filled(spark, sf)


@query(f"with {FILL_SQL}, ln as (select user_id, on_ms, row_number() over (partition by user_id order by on_ms) as i, regexp_replace(regexp_replace(printf('%d.%03d', on_ms // 1000, on_ms % 1000), '0+$', ''), '\\.$', '') as a, regexp_replace(regexp_replace(printf('%d.%03d', off_ms // 1000, off_ms % 1000), '0+$', ''), '\\.$', '') as b, text from filled) select user_id, md5(string_agg('        intervals [' || i || ']:' || chr(10) || '            xmin = ' || a || chr(10) || '            xmax = ' || b || chr(10) || '            text = \"' || replace(text, '\"', '\"\"') || '\"' || chr(10), '' order by i)) as body_md5, count(*) as n from ln group by 1")
def textgrid_text(spark, sf):
    from ..sources.textgrid import interval_lines

    return interval_lines(filled(spark, sf), "user_id").select("user_id", F.md5("body").alias("body_md5"), "n")


@query(f"with {SPANS_SQL.rstrip(', ')} select user_id, count(*) as spans, count(*) filter (where off_ms // 100 * 100 <= on_ms) as skipped, bool_or(off_ms // 100 * 100 <= on_ms) as discarded from num group by 1")
def zero_width(spark, sf):
    rough = raw_spans(spark, sf).withColumn("off_ms", F.expr("off_ms div 100 * 100"))
    skipped = tiers.is_skipped()
    return rough.groupBy("user_id").agg(F.count("*").alias("spans"), F.count_if(skipped).alias("skipped"), F.bool_or(skipped).alias("discarded"))


PRESERVE_SQL = f"""with {SPANS_SQL}r as (select user_id, ord as n, on_ms, greatest(on_ms, off_ms // 100 * 100) as off_ms, ord // 3 as group_id from num),
m as (select *, on_ms >= off_ms as sk, sum(case when on_ms >= off_ms then 0 else 1 end) over w as run, on_ms >= off_ms and lag(group_id) over w is distinct from group_id as edge,
    coalesce(first_value(case when on_ms < off_ms then on_ms end ignore nulls) over (w rows between 1 following and unbounded following),
      last_value(on_ms) over (w rows between unbounded preceding and unbounded following)) as nxt
  from r window w as (partition by user_id order by n)),
q as (select *, bool_or(edge) over (partition by user_id, run order by n) as rt, count(*) over (partition by user_id, run order by n rows between current row and unbounded following) as lf from m),
f as (select user_id, n, group_id, row_number() over (partition by user_id order by n) as k, case when not sk then on_ms when rt then greatest(0, nxt - lf) else 0 end as o, case when sk then 0 else off_ms end as x from q),
c as (select *, max(greatest(x, o + 1) - k) over (partition by user_id order by n) + k as e from f)
select user_id, n, greatest(o, coalesce(lag(e) over (partition by user_id order by n), o)) as on_ms, e as off_ms, group_id from c"""


@query(PRESERVE_SQL)
def preserve_skips(spark, sf):
    off = F.greatest("on_ms", F.expr("off_ms div 100 * 100")).alias("off_ms")
    rough = raw_spans(spark, sf).select("user_id", F.col("ord").alias("n"), "on_ms", off, F.expr("ord div 3").alias("group_id"))
    return tiers.preserve_skips(rough, "user_id", "n", "group_id")


@query("select event_id, round(value * 1000) as ms, cast(round(value) as bigint) as s from events".replace("round(value * 1000) as ms", "cast(round(value * 1000) as bigint) as ms"))
def ms_round(spark, sf):
    return table(spark, sf, "events").select("event_id", X.milliseconds(F.col("value")).alias("ms"), F.round("value").cast("long").alias("s"))


@query("select event_id, user_id, coalesce(last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), -1) as last_click from events")
def frame_asof(spark, sf):
    return lookup.latest_before(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click", "event_id", "last_click").select("event_id", "user_id", F.coalesce("last_click", F.lit(-1)).alias("last_click"))


@query(f"with {CLAMP_SQL}, pt as (select user_id, event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000 + 1500000 as at_ms from events where event_type = 'view') select pt.user_id, event_id, at_ms, coalesce(min(ord) filter (where on_ms <= at_ms and off_ms >= at_ms), max(ord) filter (where on_ms <= at_ms), 1) as owner from pt left join cl on cl.user_id = pt.user_id and on_ms <= at_ms group by all")
def interval_owner(spark, sf):
    points = table(spark, sf, "events").filter("event_type = 'view'").select("user_id", "event_id", (X.since_2024_ms(F.col("ts")) + 1_500_000).alias("at_ms"))
    return lookup.owner_at(points, clamped(spark, sf).select("user_id", "ord", "on_ms", "off_ms"), "user_id")


# ---- evaluation

PAIRS_SQL = CLAMP_SQL + ", pr as (select cl.user_id, abs(cl.on_ms - num.on_ms) as d_on, abs(cl.off_ms - num.off_ms) as d_off, cl.text = num.text as same from cl join num using (user_id, ord))"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.paired(clamped(spark, sf), raw_spans(spark, sf), "user_id")


@query(f"with {PAIRS_SQL} select count(*) as intervals, round(avg(d_on), 6) as on_mean, round(median(d_on)::double, 6) as on_median, max(d_on) as on_max, round(avg(d_off), 6) as off_mean, round(median(d_off)::double, 6) as off_median, max(d_off) as off_max, avg(same::int::double) as label_rate, round(avg(case when d_on <= 20 and d_off <= 20 then 100.0::double else 0 end), 6) as hit_20, round(avg(case when d_on <= 60000 and d_off <= 60000 then 100.0::double else 0 end), 6) as hit_60000, list(d_on order by d_on)[count(*) * 9 // 10 + 1] as on_p90, list(d_off order by d_off)[count(*) * 9 // 10 + 1] as off_p90 from pr")
def eval_summary(spark, sf):
    s = evaluate.summary(pairs(spark, sf), [20, 60000])
    return s.withColumns({c: F.round(c, 6) for c in ("on_mean", "on_median", "off_mean", "off_median", "hit_20", "hit_60000")})


@query(f"with {PAIRS_SQL} select user_id, round(avg(d_on), 6) as mae, count(*) as n from pr group by 1 order by avg(d_on) desc, user_id desc, n desc limit 10")
def eval_worst_k(spark, sf):
    return evaluate.worst(pairs(spark, sf), "user_id", 10).withColumn("mae", F.round("mae", 6))


RUN_SQL = CLAMP_SQL + """, kept as (select *, row_number() over (partition by user_id order by ord) as pos from cl
  where user_id not in (select user_id from num where greatest(on_ms, off_ms // 100 * 100) <= on_ms)),
pr as (select num.user_id, kept.ord is not null as met, abs(kept.on_ms - num.on_ms) as d_on, abs(kept.off_ms - num.off_ms) as d_off, kept.text <> num.text as missed
  from num left join kept on kept.user_id = num.user_id and kept.pos = num.ord)
select user_id, count(*) as n, count(*) filter (where met) as n_other, bool_and(met and d_on <= 0 and d_off <= 0) as identical, coalesce(max(greatest(d_on, d_off)), 0) as max_diff,
  round(coalesce(avg((d_on + d_off) / 2.0::double), 0), 6) as mean_diff, count(*) filter (where missed) as label_misses from pr group by 1"""


@query(f"with {RUN_SQL}")
def run_diff(spark, sf):
    """Raw spans against the clamped ones of a run that discards users with a skipped span."""
    raw = raw_spans(spark, sf)
    rough = raw.withColumn("off_ms", F.greatest("on_ms", F.expr("off_ms div 100 * 100")))
    kept = clamped(spark, sf).join(tiers.handle_skips(rough, "user_id", "discard").select("user_id").distinct(), "user_id", "left_semi")
    return evaluate.run_difference(raw, kept, "user_id").withColumn("mean_diff", F.round("mean_diff", 6))


# ---- signals

SIG_SQL = "sig as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value from events)"
WIN, HOP = 16, 8


def signals(spark: SparkSession, sf: str) -> DataFrame:
    seq = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", (F.row_number().over(seq) - 1).alias("i"), "value")


@query(f"""with {SIG_SQL}, fr as (select user_id, unnest(range(greatest(i - {WIN - 1} + {HOP - 1}, 0) // {HOP}, i // {HOP} + 1)) as t, i, value from sig), w as (select user_id, t, i - t * {HOP} as j, value * (0.5 - 0.5 * cos(2 * pi() * (i - t * {HOP}) / {WIN})) as x from fr), ok as (select user_id, t from w group by all having count(*) = {WIN})
select user_id, t, k, round(ln(greatest(sqrt(pow(sum(x * cos(2 * pi() * k * j / {WIN})), 2) + pow(sum(x * sin(2 * pi() * k * j / {WIN})), 2)), 1e-5)), 5) as m from w join ok using (user_id, t), (select unnest(range({WIN // 2 + 1})) as k) group by all""")
def log_spectrum(spark, sf):
    return signal.log_spectrum(signals(spark, sf), "user_id", WIN, HOP).withColumn("m", F.round("m", 5))


@query(f"with {SIG_SQL} select a.user_id, o.j, round(sum(b.value * (1 - abs(b.i - o.j * 1.5)/2)) / sum(1 - abs(b.i - o.j * 1.5)/2), 6) as y from (select user_id, count(*) as n from sig group by 1) a, lateral (select unnest(range(n * 2 // 3)) as j) o join sig b on b.user_id = a.user_id and abs(b.i - o.j * 1.5) < 2 group by all")
def resample_fir(spark, sf):
    return signal.resample_tent(signals(spark, sf), "user_id", 3, 2).withColumn("y", F.round("y", 6))


@query("select user_id, min(ts) as started, max(ts) as ended, count(*) as n from (select *, sum(st) over (partition by user_id order by ts, event_id) as s from (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 2 hour then 0 else 1 end as st from events)) group by user_id, s")
def sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.to_timestamp("ts"))
    return e.groupBy("user_id", F.session_window("at", "2 hours")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).select("user_id", "started", "ended", "n")


@query(f"""{DECODE_SQL}, kept as (select clip_id, on_f * 10 as on_ms, off_f * 10 as off_ms, 'label' || n as text from spans where on_f < off_f
  union all select clip_id, frames * 10, null, null from (select distinct clip_id, frames from spans)),
prev as (select *, coalesce(lag(off_ms) over (partition by clip_id order by on_ms, off_ms nulls last), 0) as p from kept)
select clip_id, on_ms, off_ms, text from prev where off_ms is not null union all select clip_id, p, on_ms, 'SP' from prev where p < on_ms""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to clips, similarities, decode, spans in milliseconds and the gap-filled tier."""
    sims = similarities(spark, sf)
    spans = decode.decode_clips(sims).select("clip_id", F.col("n").cast("long").alias("n"), F.concat(F.lit("label"), "n").alias("text"), (F.col("on_f") * 10).cast("long").alias("on_ms"), (F.col("off_f") * 10).cast("long").alias("off_ms"))
    spans = tiers.clamp(tiers.handle_skips(spans, "clip_id", "omit"), "clip_id", "n")
    ends = sims.groupBy("clip_id").agg(((F.max("t") + 1) * 10).cast("long").alias("end_ms"))
    return tiers.fill_gaps(spans, "clip_id", ends, "SP").orderBy("clip_id", "on_ms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


