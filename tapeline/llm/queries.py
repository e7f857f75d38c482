"""Registered queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.io import table
from tapeline.llm import consensus, copies, glyphs, language, leakage, mixing, targets, truncation


def _records(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["title", "domain", "seendate"]
    articles = copies.json_fields(table(spark, sf, "raw_articles"), "raw_id", "payload", fields)
    return (
        copies.canonical_records(table(spark, sf, "headlines"), "headline_id", fields)
        .withColumn("table_name", F.lit("headlines"))
        .unionByName(copies.canonical_records(articles, "row_id", fields).withColumn("table_name", F.lit("raw_articles")))
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.find_copies(_records(spark, sf), ["table_name"]).select("table_name", "first_id", "copy_id")


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record with its number of copies."""
    return copies.count_copies(_records(spark, sf), ["table_name"])[1].select("table_name", "first_id", "copies")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return targets.gaps(spark, targets.allocate(table(spark, sf, "annotation_pool"), table(spark, sf, "sample_targets"))[1])


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    units, plan = targets.allocate(table(spark, sf, "annotation_pool"), table(spark, sf, "sample_targets"))
    return targets.draw(units, plan).withColumnRenamed("unit", "pool_id")


def p2_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What each target category needs, has and is planned to give to the sample."""
    plan = targets.plan_frame(spark, targets.allocate(table(spark, sf, "annotation_pool"), table(spark, sf, "sample_targets"))[1])
    return plan.withColumn("planned", F.round("planned", 3))


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every category of the drawn samples."""
    return targets.shares(*targets.allocate(table(spark, sf, "annotation_pool"), table(spark, sf, "sample_targets")))


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    headlines = table(spark, sf, "headlines").select("headline_id", "title", "language")
    return language.identify(headlines, "title", language.fit_on(headlines, table(spark, sf, "documents")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.mislabelled(_identified(spark, sf), "headline_id", "language")


def p3_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every title and of every part of a mixed one, with its confidence."""
    parts = _identified(spark, sf).select("headline_id", F.posexplode("parts").alias("part_no", "part"))
    return parts.select("headline_id", "part_no", "part.*", (F.col("part.confidence") < 0.6).alias("ambiguous"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.lookalike_pairs(table(spark, sf, "headlines"), "headline_id", "title")


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Membership of the groups of look-alike titles: every row once, without its pairs."""
    return glyphs.lookalike_groups(table(spark, sf, "headlines"), "headline_id", "title")


def p6_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every title in its consistent form."""
    return table(spark, sf, "headlines").select("headline_id", glyphs.consistent_form(F.col("title")).alias("normal_title"))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.confusable_report(table(spark, sf, "headlines"), "title")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    items, usable = consensus.consensus(table(spark, sf, "annotation_labels"))
    return consensus.answers(items, consensus.reliability(usable, items))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """The consensus of every item: criticism, category, intensity."""
    items, usable = consensus.consensus(table(spark, sf, "annotation_labels"))
    scores = consensus.intensity(usable, items, consensus.reliability(usable, items))
    return items.join(scores, "item", "left").select("item", "yes", "no", "truth", "category", "intensity")


def p7_annotators(spark: SparkSession, sf: str) -> DataFrame:
    items, usable = consensus.consensus(table(spark, sf, "annotation_labels"))
    return consensus.reliability(usable, items)


def p7_agreement(spark: SparkSession, sf: str) -> DataFrame:
    found = consensus.agreement(consensus.label_rows(table(spark, sf, "annotation_labels")))
    return found.select("field", "items", "pairs", F.round("observed", 6).alias("observed"), F.round("alpha", 6).alias("alpha"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per item that leaked, the number of documents that hold some of it."""
    return p8_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shortfalls(spark, mixing.plan_mixtures(mixing.measured(table(spark, sf, "documents")), table(spark, sf, "mix_targets")))


def _mixture(spark: SparkSession, sf: str):
    sizes = mixing.measured(table(spark, sf, "documents"))
    plan = mixing.plan_mixtures(sizes, table(spark, sf, "mix_targets"))
    return mixing.mix(sizes, plan), plan


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "documents"))


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(table(spark, sf, "documents"))


QUERIES = {q.__name__: q for q in (p1_found, p1_records, p2_found, p2_plan, p2_sample, p2_shares, p3_found, p3_parts, p6_found, p6_groups, p6_titles, p6_report, p7_found, p7_items, p7_annotators, p7_agreement, p8_found, p8_items, p9_found, p9_mixture, p9_shares, p10_found, p10_rates)}
_CASES = " union all ".join(
    f"select '{t}' as table_name, {i} as id, title, domain, seendate from {source}"
    for t, i, source in (("headlines", "headline_id", "headlines"), ("raw_articles", "raw_id", "(select raw_id, json_extract_string(payload, '$.title') as title, json_extract_string(payload, '$.domain') as domain, json_extract_string(payload, '$.seendate') as seendate from raw_articles where json_valid(payload))"))
)
_KEYS = ", ".join(rf"regexp_replace(replace(lower({f}), 'ß', 'ss'), '[\s\p{{Z}}\p{{P}}\x1c-\x1f\x{{85}}]+', '', 'g') as k{n}" for n, f in enumerate(("title", "domain", "seendate")))
_FILLED = " and ".join(rf"regexp_matches({f}, '[^\s\p{{Z}}\x1c-\x1f\x{{85}}]')" for f in ("title", "domain", "seendate"))
_RECORDS = f"with cases as ({_CASES}), keyed as (select table_name, id, {_KEYS} from cases where {_FILLED}), firsts as (select *, min(id) over (partition by table_name, k0, k1, k2) as first_id from keyed)"
_CATEGORY = lambda c: rf"coalesce(regexp_replace(regexp_replace(lower({c}), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[-\s\p{{Z}}]', '_', 'g'), '')"

_OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"

#: The SQL of what SQL can say; the other queries are tested against brute force, round trips or held-out rows.
SQL = {
    "p1_found": f"{_RECORDS} select table_name, first_id, id as copy_id from firsts where id != first_id",
    "p1_records": f"{_RECORDS} select table_name, first_id, count(*) as copies from firsts group by table_name, first_id, k0, k1, k2",
    "p2_found": f"""with units as (select distinct pool_id, {_CATEGORY('sample_stratum')} as a, {_CATEGORY('query_type')} as b from annotation_pool where pool_id is not null),
n as (select count(distinct pool_id) as n from units), have as (select a, b, count(*) as available from units group by a, b),
need as (select *, {_CATEGORY('sample_stratum')} as a, {_CATEGORY('query_type')} as b, draw_pct * n // 100 as size from sample_targets, n)
select distinct target_set, sample_stratum, query_type from need left join have using (a, b) where coalesce(available, 0) < greatest(min_rows, (target_pct * size + 99) // 100)""",
    "p7_agreement": rf"""with one as (select * from annotation_labels where id is not null and annotator is not null and label_id is not null qualify row_number() over (partition by id, annotator order by label_id) = 1),
clean as (select id as item, regexp_replace(criticism_label, '{_OUTER}', '', 'g') as said, {_CATEGORY('category_label')} as category, try_cast(replace(regexp_replace(intensity_score, '{_OUTER}', '', 'g'), ',', '.') as double) as score from one),
v as (select 'criticism_label' as field, item, said as value from clean where said in ('0', '1') union all select 'category_label', item, category from clean where category in {consensus.CATEGORIES}
 union all select 'intensity_score', item, cast(score as varchar) from clean where score between 0 and 3),
c as (select field, item, value, count(*) as c from v group by all), i as (select field, item, sum(c) as n, sum(c * (c - 1)) as same from c group by all having sum(c) > 1),
p as (select field, value, sum(c) as c from c semi join i using (field, item) group by all), e as (select field, sum(c) as total, sum(c * (c - 1)) as alike from p group by field),
o as (select field, count(*) as items, cast(sum(n * (n - 1)) / 2 as bigint) as pairs, sum(same) / sum(n * (n - 1)) as observed, sum(same / (n - 1)) as o from i group by field)
select field, items, pairs, round(observed, 6) as observed, round(case when alike < total * (total - 1) then (o / total - alike / (total * (total - 1))) / (1 - alike / (total * (total - 1))) end, 6) as alpha from o join e using (field)""",
    # free categories are k * target_pct, between minimum and what there is; k lies between two of the values where a category meets a bound
    "p2_plan": f"""with units as (select distinct pool_id, {_CATEGORY('sample_stratum')} as a, {_CATEGORY('query_type')} as b from annotation_pool where pool_id is not null),
n as (select count(distinct pool_id) as n from units), have as (select a, b, count(*) as available from units group by a, b),
need as (select *, {_CATEGORY('sample_stratum')} as a, {_CATEGORY('query_type')} as b, draw_pct * n // 100 as size from sample_targets, n),
rows_ as (select need.*, coalesce(available, 0) as available, greatest(min_rows, (target_pct * size + 99) // 100) as needed from need left join have using (a, b)),
cells as (select target_set, a, b, first(available)::double as hi, sum(target_pct)::double as t, least(sum(min_rows), first(available))::double as lo, first(size)::double as size from rows_ group by target_set, a, b),
totals as (select target_set, least(greatest(first(size) * sum(t) / 100, sum(lo)), sum(hi)) as total from cells group by target_set),
points as (select distinct target_set, k from (select target_set, lo / t as k from cells where t > 0 union all select target_set, hi / t from cells where t > 0 union all select target_set, 0.0 from cells)),
sums as (select p.target_set, k, sum(least(hi, greatest(lo, k * t))) as f from points p join cells c using (target_set) group by p.target_set, k),
steps as (select *, lead(k) over w as k1, lead(f) over w as f1 from sums window w as (partition by target_set order by k)),
root as (select s.target_set, min(case when coalesce(f1, f) > f then k + (total - f) / (f1 - f) * (k1 - k) else k end) as k from steps s join totals using (target_set) where total >= f - 1e-9 and (total <= f1 or f1 is null) group by s.target_set),
planned as (select target_set, a, b, least(hi, greatest(lo, k * t)) as planned, case when hi = 0 or k * t > hi + 1e-6 then 'all taken' when k * t < lo - 1e-6 then 'floor' else 'free' end as held from cells left join root using (target_set))
select target_set, sample_stratum, query_type, target_pct, cast(needed as bigint) as needed, available, round(planned, 3) as planned, held from rows_ join planned using (target_set, a, b)""",
}
